"""Knotwork: property-graph analytics expressed as Spark DataFrame jobs."""
