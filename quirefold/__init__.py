"""Spark-first analytics over annotated document records."""

__version__ = "0.1.0"
