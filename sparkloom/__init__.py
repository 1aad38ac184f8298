"""Spark-native analytics over memories, genes, code graphs, transcripts and their state."""
