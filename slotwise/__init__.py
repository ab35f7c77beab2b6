"""slotwise: causal time-series analytics on Spark DataFrames."""
