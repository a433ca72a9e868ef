"""Operators for building training data at scale. Nothing outside this folder imports it."""
