"""Spark-native analytics over decision records, rule screening and text corpora."""
