"""Operators for text and corpus-wide statistics. Nothing outside this package imports it."""
