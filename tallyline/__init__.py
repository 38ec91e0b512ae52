"""A PySpark-native engine for statement ledgers and for preparing text corpora."""
