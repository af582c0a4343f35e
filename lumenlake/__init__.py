"""A Spark-native engine for text corpora and the event logs around them."""
