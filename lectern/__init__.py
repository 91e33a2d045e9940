"""Document-library analytics on Spark."""
