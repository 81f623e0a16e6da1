"""Directory and training-data analytics on Spark."""
