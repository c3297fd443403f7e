"""Operators for building training corpora at cluster scale."""
