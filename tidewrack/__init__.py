"""tidewrack: a PySpark-native crawl, index and similarity-search engine."""

__version__ = "0.1.0"
