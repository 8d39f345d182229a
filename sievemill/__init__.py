"""sievemill: a PySpark-native engine for data preparation, retrieval, scoring and preference data."""
