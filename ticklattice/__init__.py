"""Market-microstructure analytics on Spark: ordered event logs as DataFrames."""
