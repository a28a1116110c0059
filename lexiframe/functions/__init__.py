"""Column expressions, Arrow kernels and fixed values."""
