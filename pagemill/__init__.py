"""pagemill: Spark-native operators for turning crawled pages into structured, attributed records."""
