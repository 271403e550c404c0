"""Readers and payload-to-listing jobs."""
