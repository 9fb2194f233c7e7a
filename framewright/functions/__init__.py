"""Column builders: everything here stays inside Spark's generated code."""
