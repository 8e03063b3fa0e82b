"""retrospect: the past state of tables, and the preparation of text corpora, on Spark."""
__version__ = "0.1.0"
