"""Readers, writers and the store's table schemas."""
