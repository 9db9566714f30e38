"""millrace: a PySpark-native engine for timeline analytics and corpus preparation."""
