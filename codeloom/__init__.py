"""codeloom: a code knowledge graph engine on Spark DataFrames."""
