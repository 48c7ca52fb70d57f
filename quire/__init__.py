"""quire: a PySpark-native engine for paged document corpora."""
