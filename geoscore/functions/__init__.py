"""Column expressions; every one stays inside Spark's own functions."""
