"""A PySpark-native engine for scanning, sorting and range-partitioning columnar data."""
