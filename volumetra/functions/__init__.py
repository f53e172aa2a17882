"""Column functions on vectors and shapes, and vectorised kernels."""
