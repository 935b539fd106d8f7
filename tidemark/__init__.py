"""Market-data analytics expressed as Spark jobs."""
