"""quernstone: a Spark-native full-text search and text-processing engine."""

__version__ = "0.1.0"
