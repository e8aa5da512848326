"""Readers that turn files into DataFrames."""
