"""Vintage-aware panel analytics expressed as Spark DataFrame jobs."""
