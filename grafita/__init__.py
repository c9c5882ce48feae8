"""Knowledge-graph, retrieval and corpus analytics on Spark DataFrames."""
