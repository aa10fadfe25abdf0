"""Dense typed arrays, deferred tasks and index algebra on Spark DataFrames."""
