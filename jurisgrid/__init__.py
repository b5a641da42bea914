"""jurisgrid: a PySpark-native analytics engine for corpora of legal documents."""
