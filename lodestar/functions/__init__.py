"""Column expressions over vectors and texts."""
