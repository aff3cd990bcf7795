"""PySpark-native match-and-attribute analytics."""
