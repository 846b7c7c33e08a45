"""Training-data operators on Spark tables."""
