"""bidloom: document-similarity and evidence analytics on Spark DataFrames."""
