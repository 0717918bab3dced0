"""Column builders and vectorised numeric kernels."""
