"""Queries as immutable values, their preparation, and their DataFrame plans."""
