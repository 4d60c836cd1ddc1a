"""maieutic: a Spark-native engine for tutor-training episode data."""

__version__ = "0.1.0"
