"""Column expressions and small kernels shared by the operators."""
