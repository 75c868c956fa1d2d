"""Analytics over detection streams, on Spark DataFrames."""
