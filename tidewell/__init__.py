"""A PySpark-native engine for barcoded single-cell reads."""
