"""Knotwork streaming."""
