"""Tensor algebra and corpus preparation on Spark DataFrames."""
