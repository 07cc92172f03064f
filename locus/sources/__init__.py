"""Readers, writers and the tables they make."""
