"""millrace: a Spark-native engine for language-model corpora and training telemetry."""

__version__ = "0.1.0"
