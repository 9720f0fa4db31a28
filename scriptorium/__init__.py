"""Literature-curation analytics on PySpark: scan, consolidate, rank and report records at scale."""

__version__ = "0.1.0"
