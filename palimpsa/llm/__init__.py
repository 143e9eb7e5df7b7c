"""Operators of a large training-data pipeline; nothing else in the package imports them."""
