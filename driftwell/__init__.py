"""A PySpark engine for hybrid search and content analytics."""
