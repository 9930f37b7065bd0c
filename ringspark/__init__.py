"""Graph analytics over collections of undirected graphs, as Spark DataFrames."""
