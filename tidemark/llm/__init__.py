"""Operators for training-data pipelines; nothing else in this library imports them."""
