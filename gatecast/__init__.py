"""Spark-native features, joins and regression for event attendance tables."""

__version__ = "0.1.0"
