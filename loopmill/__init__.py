"""Track and route analytics as Spark jobs."""
