"""Registered queries: each runs an operator over the whole given tables, with SQL to compare."""
