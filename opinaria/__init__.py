"""Short-text sentiment analytics as PySpark DataFrame jobs."""
