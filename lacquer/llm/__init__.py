"""Operators for training-data pipelines; each module holds one operator, registered.py their queries and SQL."""
