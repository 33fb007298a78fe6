"""Rule retrieval, text verification and evaluation analytics as Spark jobs."""
