"""Log and telemetry analytics as Spark DataFrame jobs."""
