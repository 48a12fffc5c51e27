"""Review-corpus analytics and label evaluation on Spark DataFrames."""
