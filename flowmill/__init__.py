"""Network-flow analytics as Spark DataFrame operators and jobs."""
