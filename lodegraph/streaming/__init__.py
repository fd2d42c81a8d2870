"""Structured Streaming over graphs and events."""
