"""PySpark-native engine for component-origin verification."""
