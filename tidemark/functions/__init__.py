"""Scalar functions: distribution tails on NumPy and column helpers."""
