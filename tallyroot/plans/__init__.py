"""Queries over the project's tables, by name, and the SQL they are checked against."""
