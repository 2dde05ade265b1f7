"""Column expressions and the signature check."""
