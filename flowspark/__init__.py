"""PySpark-native analytics for city-scale movement data."""

__version__ = "0.1.0"
