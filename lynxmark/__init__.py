"""Spark-native engine for supervisory risk screening and corpus preparation."""
