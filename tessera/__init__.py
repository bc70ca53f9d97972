"""Corpus analytics on Spark: chunking, retrieval, citation checks and evaluation as DataFrame plans."""
