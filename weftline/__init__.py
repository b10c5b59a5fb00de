"""weftline: a Spark-native engine over conversation and agent-session history."""

__version__ = "0.1.0"
