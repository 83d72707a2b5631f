"""Column-to-column functions; all are built-in Spark SQL expressions."""
