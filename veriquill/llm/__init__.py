"""Training-data operators: one module for each, all working on Spark DataFrames."""
