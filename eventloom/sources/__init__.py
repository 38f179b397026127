"""Readers, writers and file utilities."""
