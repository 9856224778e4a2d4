"""Spark-native engine for version-store relations, graphs and logs."""
