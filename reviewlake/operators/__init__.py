"""Operators over the library's tables."""
