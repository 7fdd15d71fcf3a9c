"""Operators for cleaning very large text corpora; nothing else in the library imports this package."""
