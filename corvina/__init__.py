"""Corvina: a Spark-native curation, matching and search engine for record corpora."""
