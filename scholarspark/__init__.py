"""A PySpark-native analytics engine for scholarly-document corpora and citation graphs."""
