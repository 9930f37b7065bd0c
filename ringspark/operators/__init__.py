"""Operators on graphs: DataFrames in, DataFrames out, always keyed by graph_id."""
