"""Lacuna: PySpark-native analytics for irregular, incomplete time series."""

__version__ = "0.1.0"
