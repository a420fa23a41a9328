from millrace.sources.delimited import read_delimited, write_delimited
from millrace.sources.tables import field_sum, read_table, read_tables, values

__all__ = ["field_sum", "read_delimited", "read_table", "read_tables", "values", "write_delimited"]
