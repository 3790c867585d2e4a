"""folioforge: a PySpark-native engine for book-scale text, transcript and timeline data."""
