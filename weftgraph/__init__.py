"""weftgraph: typed document graphs built, resolved and queried as Spark DataFrames."""
