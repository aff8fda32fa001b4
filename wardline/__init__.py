"""wardline: dispatch-operations and data-preparation analytics as Spark jobs."""
