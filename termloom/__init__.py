"""Spark-native operators over terminology corpora: matching, search, taxonomy,
similarity graphs, quality rules, extraction and user-event state."""
