"""Log and corpus analytics as Spark jobs."""
