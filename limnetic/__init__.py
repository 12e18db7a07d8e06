"""Field-survey analytics as Spark DataFrame jobs."""
