"""Scalar and aggregate semantics."""
