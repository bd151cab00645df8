"""newsloom: news text to time-sliced knowledge graph, as Spark DataFrame operators."""
