"""Packgraph: typed and semi-structured evidence graphs as Spark DataFrames."""
