"""Leakage-safe history features and predictor statistics on Spark DataFrames."""
