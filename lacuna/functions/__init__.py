"""Scalar and array expressions: Column in, Column out."""
