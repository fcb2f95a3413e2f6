"""Operators that prepare text collections for training. Nothing outside this folder imports it."""
