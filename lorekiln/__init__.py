"""A Spark-native engine for text corpora: pure ``DataFrame -> DataFrame`` operators and a query catalogue."""
