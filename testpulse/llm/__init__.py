"""Operators for training data, their queries and checking SQL."""
