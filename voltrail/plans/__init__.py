"""Registered queries: an operator on its table, and the same in SQL."""
