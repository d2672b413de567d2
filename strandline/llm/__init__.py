"""Operators for training-data pipelines over texts and sequences. Nothing outside this package imports it."""
