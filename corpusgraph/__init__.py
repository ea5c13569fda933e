"""corpusgraph: document-collection analytics expressed as PySpark plans."""
