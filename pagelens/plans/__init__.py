"""Whole plans: the rendered layout of plain text, and the catalogue of queries."""
