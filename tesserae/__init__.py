"""A PySpark-native engine for document retrieval, its evaluation and the preparation of text corpora."""
