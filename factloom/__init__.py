"""factloom: evidence-graph analytics expressed as Spark jobs."""
