"""Spark-first analytics over media metadata, transcripts, work queues and text corpora."""
