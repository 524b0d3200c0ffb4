"""Full-text search and retrieval evaluation on Spark DataFrames."""
