"""Column expressions: every scalar rule is a built-in expression, never a Python UDF."""
