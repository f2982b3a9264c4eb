"""Incremental runs over directories that grow."""
