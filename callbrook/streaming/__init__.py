"""Structured Streaming twins of the call operators."""
