"""PySpark-native terrain, drainage-network and label analytics."""
