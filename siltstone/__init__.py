"""A Spark-native, versioned key-value table engine with log-structured storage."""

__version__ = "0.1.0"
