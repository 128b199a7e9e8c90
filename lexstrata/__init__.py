"""Spark-first operators for document corpora, retrieval, evaluation and chat traffic."""
