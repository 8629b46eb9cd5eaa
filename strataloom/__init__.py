"""Survey-weighted association jobs and training-data operators as Spark DataFrame jobs."""
