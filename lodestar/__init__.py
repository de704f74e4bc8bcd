"""Lodestar: vector compression, retrieval and audit as Spark plans.

A table of vectors is an ordinary DataFrame ``(id, vec ARRAY<FLOAT>, ...)``; a
codec is a pair of column expressions, a search is a scored projection followed
by a per-query top-k, and training yields a small table of centroids.
"""

__version__ = "0.1.0"
