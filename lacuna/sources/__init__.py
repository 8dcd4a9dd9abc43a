"""Readers of episode files and tables, generators of synthetic data, and sinks."""
