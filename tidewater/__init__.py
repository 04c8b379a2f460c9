"""Tidewater: a Spark-native engine for data quality, cleaning and entity resolution."""

__version__ = "0.1.0"
