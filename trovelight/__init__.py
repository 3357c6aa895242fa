"""trovelight: Spark-native analytics for evidence-grounded retrieval."""
