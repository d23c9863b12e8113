"""Column builders and array functions."""
