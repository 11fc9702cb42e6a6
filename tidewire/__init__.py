"""Spark-first analytics over streams of text captures: enrichment, label and tag lookups, facets, and windowed signals."""
