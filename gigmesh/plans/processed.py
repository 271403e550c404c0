"""The processing plan: normalize, resolve duplicates, filter."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gigmesh.operators import filters, resolve
from gigmesh.operators.normalize import normalize_listings


def processed(
    raw: DataFrame, as_of, venues: DataFrame | None = None, strict_genre: bool = False, **genre
) -> DataFrame:
    """Clean, unique, current listings.

    Past listings go before duplicates are searched: clusters never cross days, so
    the result is the same and a date-ordered table is read from today on only.
    """
    current = filters.not_past(raw, as_of)
    unique = resolve.deduplicate(normalize_listings(current, venues))
    return filters.genre_filter(unique, strict=strict_genre, **genre)
