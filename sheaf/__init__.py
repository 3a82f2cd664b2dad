"""sheaf: a PySpark engine for building and querying large document corpora."""
