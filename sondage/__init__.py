"""Spark-first retrieval analytics: lexical, vector and hybrid search over file corpora."""
