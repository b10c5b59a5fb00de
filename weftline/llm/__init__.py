"""Operators for conversation texts and training corpora. Nothing outside this package imports it."""
