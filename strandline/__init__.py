"""strandline: a PySpark-native engine for biological-sequence and corpus data."""

__version__ = "0.1.0"
