"""Profiling of large model corpora as Spark tables."""
