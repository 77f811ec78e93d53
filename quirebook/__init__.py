"""Note retrieval, exact search, graph, mutation, session and event operators on Spark DataFrames."""
