"""Quillon: vector retrieval, re-ranking, graph and record-linkage analytics as Spark plans."""
