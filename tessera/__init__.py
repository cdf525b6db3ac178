"""Spark-native geo-gridding, interpolation, interval and corpus analytics."""
