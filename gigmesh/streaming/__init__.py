"""Structured Streaming jobs and run-to-run state."""
