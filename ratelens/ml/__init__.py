"""Modelling and evaluation on Spark ML and DataFrames."""
