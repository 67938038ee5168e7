"""Gridloom: proximity joins and dense array analytics on PySpark DataFrames."""
