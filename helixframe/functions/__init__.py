"""Column builders: scalar functions that stay inside Spark's expressions."""
