"""lodestack: a PySpark-native engine for document search, catalog upkeep and corpus preparation."""
