"""Activity analytics on Spark."""
