"""Operators for building training data from a corpus; nothing else in the library imports this package."""
