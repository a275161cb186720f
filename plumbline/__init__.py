"""Plumbline: comparable scores from many partly overlapping sources, as Spark jobs."""
