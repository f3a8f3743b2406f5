"""Incremental runs over bookmark files that keep arriving."""
