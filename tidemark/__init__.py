"""Spark-native volatility analytics over large panels of assets."""
