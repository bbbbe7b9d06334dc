"""Media metadata and training-data operators as Spark DataFrame jobs."""
