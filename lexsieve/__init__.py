"""Corpus-classification analytics as DataFrame jobs on Apache Spark."""

__version__ = "0.1.0"
