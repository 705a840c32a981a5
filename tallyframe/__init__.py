"""Spark-native analytics over household ledgers: sources, marts, operators, plans and streaming ingest."""
