"""Network analytics of spatio-temporal fields on Spark DataFrames."""
