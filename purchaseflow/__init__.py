"""Purchase-to-pay data operators for Spark: DataFrames in, DataFrames out."""
