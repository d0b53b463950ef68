"""cairn: a Spark-native code-intelligence and corpus analytics engine."""

__version__ = "0.1.0"
