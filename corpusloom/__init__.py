"""corpusloom: a document graph, search and context engine, and training-data operators, on Spark."""
