"""Record linkage and corpus analytics on Spark DataFrames."""
