"""Spark-native analytics for mixed-type tables: clustering, its quality, feature selection and profiles."""

__version__ = "0.1.0"
