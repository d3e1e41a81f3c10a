"""A Spark-native engine for social-trend analytics: DataFrame functions for windows, brands, forecasts and text."""
