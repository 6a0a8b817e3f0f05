"""tessera: experiment analytics and corpus preparation on Spark DataFrames."""
