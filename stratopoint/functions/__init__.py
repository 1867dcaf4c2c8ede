"""Column expressions and small constant-size linear algebra."""
