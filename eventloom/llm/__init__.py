"""Operators for cleaning, scoring and packing training text; nothing else in the library imports this package."""
