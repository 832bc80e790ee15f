"""Spark-native analytics over scientific evidence: claims, relations, beliefs, retrieval and audits."""
