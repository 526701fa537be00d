"""A PySpark-native analytics and data-mining engine."""
