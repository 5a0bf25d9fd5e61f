"""Spark-native analytics over opaque blobs, byte regions and text corpora."""
