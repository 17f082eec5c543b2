"""Portfolio-ledger analytics on Spark DataFrames."""
