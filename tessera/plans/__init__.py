"""Queries over the given tables: each operator on stand-in rows, with the SQL that must give the same."""
