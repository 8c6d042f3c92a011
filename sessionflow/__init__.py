"""Intraday session and order-flow analytics on PySpark DataFrames."""
