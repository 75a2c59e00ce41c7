"""A Spark-native engine for building and measuring retrieval pipelines over document collections."""
