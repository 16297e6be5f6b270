"""Operators that prepare text for model training. Nothing outside this folder imports it."""
