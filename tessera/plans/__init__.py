"""SQL text to syntax tree to Spark SQL."""
