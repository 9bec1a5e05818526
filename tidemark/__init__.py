"""Forecasting and revenue analytics over Spark DataFrames."""
