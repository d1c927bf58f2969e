"""quern: code-graph, text-retrieval and corpus analytics as Spark DataFrames."""
