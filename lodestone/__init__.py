"""Lodestone: governed retrieval, evaluation and operations analytics on PySpark."""
