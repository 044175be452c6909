"""Spark-native analytics for wide profile tables (observations x features)."""
