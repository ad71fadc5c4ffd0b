"""Code-graph retrieval, ranking and replicated state over Spark DataFrames."""
