"""Knotwork functions."""
