"""Property-transaction analytics as Spark jobs."""
