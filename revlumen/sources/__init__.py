"""Readers, writers and derived review tables."""
