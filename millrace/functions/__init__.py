from millrace.functions.scalar import FUNCTIONS, SQL_FUNCTIONS, int_avg, list_functions, register

__all__ = ["FUNCTIONS", "SQL_FUNCTIONS", "int_avg", "list_functions", "register"]
