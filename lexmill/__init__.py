"""lexmill: a Spark-native engine for corpus retrieval and text analytics."""
