"""Registered queries, each next to the SQL that checks it."""

from registry.base import ORACLES, QUERIES  # noqa: F401


def load() -> None:
    """Import every query module once."""
    from registry import (  # noqa: F401
        q_dimension, q_extract, q_filters, q_resolve, q_scalars, q_state, q_views, q_windows,
    )
