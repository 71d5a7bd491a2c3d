"""Spark-native scoring, calibration and evaluation of verification trials."""
