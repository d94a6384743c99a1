"""Column expressions: each function takes and returns Spark columns."""
