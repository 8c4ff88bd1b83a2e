"""Operators for training-data pipelines of language models."""
