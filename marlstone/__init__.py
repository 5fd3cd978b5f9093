"""Cross-lingual retrieval, knowledge-graph and learning analytics on Spark DataFrames."""
