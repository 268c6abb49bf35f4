"""Column expressions and windows that operators share."""
