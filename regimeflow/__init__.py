"""Spark-native analytics for low-order dynamical systems."""
