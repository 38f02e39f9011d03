"""tierflow: tiered-table batch processing on Spark DataFrames."""
