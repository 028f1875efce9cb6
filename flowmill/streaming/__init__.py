"""Structured Streaming forms of the pipeline."""
