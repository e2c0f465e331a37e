"""Spark-native analytics over compressed streams: decoding, features, attribution, verification and verdicts."""
