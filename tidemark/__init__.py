"""Keyed time-series analytics on PySpark."""
