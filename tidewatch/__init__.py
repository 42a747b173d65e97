"""Spark-native anomaly-detection data work on flow tables, event traces and measurement streams."""
