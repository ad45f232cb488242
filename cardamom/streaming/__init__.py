"""Structured Streaming over call logs."""
