"""joblake: job-listing ingestion, matching and analytics on Spark DataFrames."""
