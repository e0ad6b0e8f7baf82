"""Knotwork operators."""
