"""Operators that a large training-data pipeline needs. Nothing outside imports this."""
