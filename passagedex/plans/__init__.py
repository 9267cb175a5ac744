"""Stored indexes and the searches over them."""
