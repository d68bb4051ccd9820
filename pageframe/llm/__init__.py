"""Operators of a training-data pipeline, their queries and expected results."""
