"""Column expressions; none uses a Python UDF."""
