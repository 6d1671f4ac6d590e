"""Spark-native monthly price, rent and risk analytics for regional housing panels."""
