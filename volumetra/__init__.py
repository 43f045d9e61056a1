"""Spark-native analytics for volumetric time series and gaze-style label signals."""
