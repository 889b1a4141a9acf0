"""A PySpark-native engine for curating, organising and scoring corpora."""
