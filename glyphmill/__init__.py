"""Spark-native analytics for image-caption corpora."""

__version__ = "0.1.0"
