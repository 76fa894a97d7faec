"""Trial and event-sequence analytics on Spark DataFrames."""
