"""Spark-native analytics over technical documents, their indexes and device transcripts."""
