"""Document evidence analytics expressed as Spark DataFrames."""
