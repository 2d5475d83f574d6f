"""Column expressions: window kernels and scalar functions."""
