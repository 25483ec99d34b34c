"""palimpsest: a versioned-table analytics engine expressed in PySpark."""
