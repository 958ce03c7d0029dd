"""skeinmill: a PySpark-native engine for document ingestion, retrieval and corpus preparation."""
