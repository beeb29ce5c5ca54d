"""Spark-native asset cataloguing and duplicate detection."""
