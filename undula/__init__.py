"""Time-series analytics over DataFrames: one row a case, one inner array a channel."""
