"""Column functions: no joins, no aggregation, only expressions."""
