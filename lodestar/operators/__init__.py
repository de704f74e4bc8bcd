"""Operators over tables of vectors and texts."""
