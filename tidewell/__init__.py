"""PySpark-native analytics over time-stamped text, event logs, item collections and file manifests."""

__version__ = "0.1.0"
