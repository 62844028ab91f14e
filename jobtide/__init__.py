"""jobtide: a PySpark engine for analysing and replaying durable job-queue state."""
