"""Text retrieval and fuzzy matching on Spark DataFrames."""
