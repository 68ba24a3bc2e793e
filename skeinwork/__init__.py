"""Property-graph, catalog and work-item analytics as Spark DataFrame plans."""
