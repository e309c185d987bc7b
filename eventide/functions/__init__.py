"""Column expressions and Arrow-batched array functions."""
