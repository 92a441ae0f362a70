"""Analytics for labelled tables ranked by a binary target, on Spark DataFrames."""
