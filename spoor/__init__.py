"""spoor: Spark-native analytics over the execution traces of multi-agent applications."""

__version__ = "0.1.0"
