"""Risk analytics on hierarchical hexagonal grids, as Spark DataFrames."""
