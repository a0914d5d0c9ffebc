"""A Spark-native engine for multi-tenant metrics."""
