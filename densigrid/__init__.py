"""densigrid: density-grid analytics as Spark DataFrame plans."""
