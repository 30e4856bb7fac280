"""Ranked text search over document collections, as Spark plans."""
