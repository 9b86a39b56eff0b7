"""The function catalogue: how each function of the dialect is written in Spark SQL, and its class for lineage."""
