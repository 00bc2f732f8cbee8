"""Millrace: knowledge-base analytics on PySpark DataFrames."""
