"""Registered queries over the given tables, each with an SQL statement of its result."""
