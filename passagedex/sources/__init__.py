"""Readers for article dumps and helpers for shared storage."""
