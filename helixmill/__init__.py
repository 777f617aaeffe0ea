"""Short-read mapping, variant calling and training-data preparation on Spark DataFrames."""
