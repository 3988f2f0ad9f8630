"""A PySpark-native analytics engine for RNA structure-probing data."""

__version__ = "0.1.0"
