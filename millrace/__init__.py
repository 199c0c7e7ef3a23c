"""A relational engine and training-data toolkit that runs on Spark."""
