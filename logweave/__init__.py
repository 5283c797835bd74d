"""logweave: record linkage, provenance merge and logbook analytics on Spark DataFrames."""
