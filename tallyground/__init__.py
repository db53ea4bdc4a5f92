"""Incident analytics on Spark: ingest, clean, count, forecast and cluster incident tables."""
