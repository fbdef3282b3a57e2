"""lodestone: a PySpark-native engine for document collections."""

__version__ = "0.1.0"
