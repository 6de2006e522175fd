"""Sluice: analytics over interaction logs and text corpora, written as Spark plans."""

__version__ = "0.1.0"
