"""Structured Streaming over event logs: an addition to the batch engine."""
