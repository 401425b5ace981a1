"""Column expressions; all of them stay inside Spark SQL."""
