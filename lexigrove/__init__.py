"""Lexigrove: corpus, evidence and training-data analytics expressed as Spark plans."""
