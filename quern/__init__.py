"""PySpark-native engine for managed sessions, their catalogs, messages and training corpora."""
