"""Spark-native analytics for oriented point clouds, graphs and curves."""
