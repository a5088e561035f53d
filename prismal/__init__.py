"""prismal: a Spark-native engine for signal, record and text analytics."""

__version__ = "0.1.0"
