"""DataFrame operators for what Spark SQL has no form for."""
