"""tempolog: a PySpark-native engine for timestamped message logs."""

__version__ = "0.1.0"
