"""Readers and writers for landed market tables."""
