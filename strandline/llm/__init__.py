"""Operators over text corpora; nothing else in the library imports this package."""
