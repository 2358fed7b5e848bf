"""geolith: a PySpark-native engine for geospatial feature tables."""

__version__ = "0.1.0"
