from millrace.operators.relational import aggregate, derived, equi_join, filter_rows, limit, order_by, project, spread_join

__all__ = ["aggregate", "derived", "equi_join", "filter_rows", "limit", "order_by", "project", "spread_join"]
