"""millrace: corpus preparation, audit and scoring on Spark DataFrames."""
