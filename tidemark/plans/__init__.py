"""Queries and study jobs composed of the operators."""
