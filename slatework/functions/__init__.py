"""Expressions: typed comparisons and the text form of values."""
