"""Operators for large training-data sets; nothing else in the library imports them."""
