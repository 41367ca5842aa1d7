"""Queries over the star-schema tables."""
