"""Panel and social-text analytics on Spark."""
