"""Structure-property analytics as Spark DataFrame jobs."""
