"""Tamper-evident audit analytics on Spark: DataFrame in, DataFrame out."""
