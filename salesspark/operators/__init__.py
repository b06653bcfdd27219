"""Operators: each takes the sales view (a DataFrame) and returns a lazy DataFrame."""
