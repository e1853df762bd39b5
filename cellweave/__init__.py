"""Gridded and grouped time-series statistics on Spark DataFrames."""
