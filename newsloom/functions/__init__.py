"""Part of newsloom, a PySpark-native news processing engine."""
