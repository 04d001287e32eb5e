"""barloom: Spark-native analytics for ordered market time series."""
