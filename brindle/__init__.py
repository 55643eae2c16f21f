"""brindle: a PySpark-native engine for text retrieval and grounded answering."""

__version__ = "0.1.0"
