"""cellweave: semantic table annotation and data processing as Spark DataFrames."""
