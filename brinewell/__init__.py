"""brinewell: a PySpark-native search-analytics engine."""

__version__ = "0.1.0"
