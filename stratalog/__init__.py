"""Spark-native analytics over dated document archives."""
