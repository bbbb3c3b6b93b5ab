"""Whole operations: index, search, rendering."""
