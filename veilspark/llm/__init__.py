"""Operators of a training-data pipeline, and the pipeline's parts."""
