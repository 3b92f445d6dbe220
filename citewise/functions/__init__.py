"""Column expressions: every helper takes and returns Spark Columns."""
