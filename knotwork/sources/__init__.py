"""Knotwork sources."""
