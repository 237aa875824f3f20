"""Spark-native processing of pairwise preference data."""
