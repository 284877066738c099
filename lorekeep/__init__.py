"""Spark-native semantic memory analytics over text corpora, transcripts and event logs."""
