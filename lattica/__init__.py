"""A PySpark-native analytics engine for knowledge graphs held as DataFrames."""
