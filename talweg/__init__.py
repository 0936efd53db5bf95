"""Spark-native terrain hazard and asset exposure analytics."""
