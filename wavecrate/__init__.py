"""wavecrate: a PySpark-native engine for cataloguing media libraries and preparing text corpora."""
