"""Code-graph, retrieval and relational analytics as Spark jobs."""
