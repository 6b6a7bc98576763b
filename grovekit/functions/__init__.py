"""Column functions: quantizers, vectors and error measures."""
