"""Operators that prepare text collections for training language models."""
