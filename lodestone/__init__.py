"""Spark-native analytics over records, vectors, events and training text."""
