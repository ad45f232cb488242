"""A Spark-native engine for building and analysing moderation benchmarks and training corpora."""
