"""Queries over the tables of a library directory, each with the same result in SQL."""
