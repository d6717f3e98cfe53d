"""duelframe: Spark-native analytics for two-sided contest data."""
