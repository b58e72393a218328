"""codesift: code-audit analytics as Spark DataFrame jobs."""
