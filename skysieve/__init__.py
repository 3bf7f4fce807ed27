"""Spark-native sequential event triage and training-data preparation."""
