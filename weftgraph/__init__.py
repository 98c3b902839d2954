"""weftgraph: statement text to property graph analytics, all on Spark DataFrames."""
