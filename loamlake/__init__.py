"""loamlake: document-lakehouse and retrieval analytics on Spark DataFrames."""
