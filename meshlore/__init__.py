"""meshlore: a PySpark-native engine for evolving graphs and their change logs."""
