"""Training-data operators: one module each, plus shared text kernels."""
