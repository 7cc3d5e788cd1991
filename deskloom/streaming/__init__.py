"""Structured Streaming forms of the batch jobs."""
