"""Document analytics and hybrid retrieval on Spark."""
