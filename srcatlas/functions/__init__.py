"""Column functions that run inside Spark's code generation."""
