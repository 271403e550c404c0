"""Whole plans: processed listings and the published views."""
