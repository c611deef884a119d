"""Queries over the academic-shaped view of the tables, with their SQL."""
