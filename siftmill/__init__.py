"""A Spark-native engine that digests tables, nested records and documents."""
