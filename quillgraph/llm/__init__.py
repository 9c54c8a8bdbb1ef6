"""Operators for training data at scale."""
