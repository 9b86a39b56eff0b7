"""A SQL transformation engine and corpus operators on Spark."""
