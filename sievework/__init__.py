"""A Spark-native engine for clustering tool-report messages, with operators for training-data pipelines in ``llm``."""
