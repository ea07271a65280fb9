"""Industrial asset analytics as Spark jobs."""
