"""Structured Streaming forms of the log and prediction operators."""
