"""Operators for training-data pipelines; nothing else in netloom imports this package."""
