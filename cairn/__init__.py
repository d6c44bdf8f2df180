"""cairn: set-based record linkage, event curation and corpus preparation on Spark DataFrames."""
