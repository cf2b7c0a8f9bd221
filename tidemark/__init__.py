"""Tidemark: a Spark-first research-retrieval and corpus-preparation engine."""
