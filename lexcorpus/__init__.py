"""lexcorpus: a Spark-native engine for versioned, hierarchical document corpora."""

__version__ = "0.1.0"
