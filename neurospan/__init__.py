"""Spark-native analytics for multichannel recordings and behavioural trials."""
