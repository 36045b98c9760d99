"""Operators for text corpora and very large numeric columns; nothing else in the library imports this package."""
