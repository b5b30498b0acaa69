"""Structured Streaming twins of the stateful operators."""
