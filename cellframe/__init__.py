"""cellframe: lazy n-dimensional array analytics as Spark DataFrames."""
