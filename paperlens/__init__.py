"""paperlens: a PySpark-native analytics engine for a corpus of scholarly documents."""

__version__ = "0.1.0"
