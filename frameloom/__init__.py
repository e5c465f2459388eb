"""Typed dataflow pipelines over frames and signals, run as Spark DataFrames."""
