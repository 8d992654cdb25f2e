"""Column to Column expressions."""
