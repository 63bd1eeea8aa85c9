"""Spark-native analytics over a corpus of research documents."""
