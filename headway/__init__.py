"""Transit reliability analytics on Spark."""
