"""Numerical models on NumPy arrays, called from grouped and mapped functions."""
