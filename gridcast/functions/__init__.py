"""Column expressions and NumPy grid kernels."""
