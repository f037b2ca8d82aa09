"""tripspark: Spark-native analytics over trips, road networks and gazetteers."""
