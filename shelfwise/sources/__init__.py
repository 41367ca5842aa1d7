"""Readers for landed payloads and their normalisation to one row shape."""
