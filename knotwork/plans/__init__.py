"""Knotwork plans."""
