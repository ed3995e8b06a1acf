"""Source-corpus intelligence as Spark DataFrame jobs."""
