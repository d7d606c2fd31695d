"""Text, embedding and graph analytics over Spark DataFrames."""
