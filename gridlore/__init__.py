"""gridlore: a Spark-native engine for geospatial feature analytics."""
