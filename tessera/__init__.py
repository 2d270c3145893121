"""Spark-native statistical analytics over labelled observations and dense vectors."""
