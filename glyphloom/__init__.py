"""Document word analytics as Spark jobs."""
