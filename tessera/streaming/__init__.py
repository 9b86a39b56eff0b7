"""Structured Streaming beside incremental models: a stream kept up to date in a table."""
