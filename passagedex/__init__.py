"""Passage retrieval on Spark: BM25 and exact nearest neighbours as DataFrame jobs."""
