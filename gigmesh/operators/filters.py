"""Row filters and relevance labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions import fuzzy, temporal, text


def not_past(df: DataFrame, as_of) -> DataFrame:
    """Listings of today or later. The bound is a constant, so parquet can skip files."""
    return df.where(F.col("date") >= temporal.as_date(as_of).cast("timestamp_ntz"))


def lookahead(df: DataFrame, now, mode: str = "from_today", weeks: int = fx.WEEKS_AHEAD) -> DataFrame:
    """Listings up to ``weeks`` ahead of ``now``.

    ``from_now`` starts at the current instant (today's undated rows drop out),
    ``from_today`` at midnight, ``from_yesterday`` one day before the instant;
    ``open`` starts at midnight and has no end.
    """
    at = F.to_timestamp_ntz(F.lit(str(now)))
    today = F.date_trunc("day", at).cast("timestamp_ntz")
    start = {
        "from_now": at,
        "from_today": today,
        "from_yesterday": at - F.expr("INTERVAL '1' DAY"),
        "open": today,
    }[mode]
    out = df.where(F.col("date") >= start)
    if mode == "open":
        return out
    return out.where(F.col("date") <= at + F.make_dt_interval(F.lit(7 * weeks)))


def week_window(df: DataFrame, as_of, weeks: int = fx.WEEKS_AHEAD) -> DataFrame:
    return df.where(temporal.week_number(F.col("date"), as_of) < weeks)


def upcoming(df: DataFrame, as_of, days: int = 3) -> DataFrame:
    """Listings from today through ``days`` days ahead, both ends included."""
    today = temporal.as_date(as_of)
    return df.where(
        (F.col("date") >= today.cast("timestamp_ntz"))
        & (F.col("date") < F.date_add(today, days + 1).cast("timestamp_ntz"))
    )


# -- genre ---------------------------------------------------------------------


def tag_verdict(tags: Column, include=None, exclude=None, strict: bool = True) -> Column:
    """True or False from the first tag that decides, NULL when none does."""
    include = fx.GENRE_INCLUDE if include is None else include
    exclude = fx.GENRE_EXCLUDE if exclude is None else exclude

    def verdict(tag: Column) -> Column:
        low = F.lower(tag)
        kept = F.exists(text.literal_array(include), lambda w: low.contains(w))
        dropped = F.exists(text.literal_array(exclude), lambda w: low.contains(w)) if strict else F.lit(False)
        return F.when(kept, F.lit(True)).when(dropped, F.lit(False))

    decided = F.filter(F.transform(tags, verdict), lambda v: v.isNotNull())
    return F.try_element_at(decided, F.lit(1))


def priority_names(df: DataFrame, priority=None, bands: str = "bands") -> DataFrame:
    """Distinct performer names that equal, or nearly equal, a priority name.

    The test runs on distinct names. Lengths rule out most of the fixed list
    before any ratio is computed.
    """
    wanted = text.literal_array(fx.PRIORITY_BANDS if priority is None else priority)
    names = df.select(F.explode(bands).alias("band")).distinct()
    pairs = names.select(
        "band",
        F.explode(
            F.filter(wanted, lambda p: fuzzy.length_compatible(F.lower(F.col("band")), p, fx.PRIORITY_BAND_ABOVE))
        ).alias("priority"),
    )
    low_band, low_priority = F.lower("band"), F.lower("priority")
    return (
        pairs.where(fuzzy.ratio_above(low_band, low_priority, fx.PRIORITY_BAND_ABOVE))
        .select("band")
        .distinct()
    )


def is_priority_name(name: Column, priority=None) -> Column:
    """The name equals, or nearly equals, a priority name. Lengths rule out most of the fixed list before any ratio is computed."""
    wanted = text.literal_array(fx.PRIORITY_BANDS if priority is None else priority)
    near = lambda low, p: fuzzy.length_compatible(low, p, fx.PRIORITY_BAND_ABOVE) & fuzzy.ratio_above(low, F.lower(p), fx.PRIORITY_BAND_ABOVE)
    return text.bound(F.lower(name), lambda low: F.exists(wanted, lambda p: near(low, p)))


def with_priority_flag(df: DataFrame, priority=None) -> DataFrame:
    """Add boolean ``has_priority_band``. The list is fixed, so each row is tested where it is and nothing is moved."""
    hit = F.exists("bands", lambda b: is_priority_name(b, priority))
    return df.withColumn("has_priority_band", F.coalesce(hit, F.lit(False)))


def has_band_keyword(bands: Column) -> Column:
    return F.lower(F.array_join(bands, " ")).rlike("|".join(dict.fromkeys(fx.BAND_KEYWORDS)))


def is_genre_venue(venue_id: Column) -> Column:
    return F.lower(venue_id).isin(fx.GENRE_VENUES_PRIMARY + fx.GENRE_VENUES_FRIENDLY)


def genre_filter(df: DataFrame, strict: bool = False, include=None, exclude=None, priority=None) -> DataFrame:
    """Genre relevance. The lenient form keeps every row, so it costs nothing."""
    if not strict:
        return df
    verdict = tag_verdict(F.col("genre_tags"), include, exclude)
    flagged = with_priority_flag(df, priority)
    return flagged.where(F.col("has_priority_band") | F.coalesce(verdict, F.lit(False))).drop("has_priority_band")


def genre_reason(df: DataFrame, include=None, priority=None) -> DataFrame:
    """Why a row counts as relevant, first reason wins; ``default`` when none holds."""
    tag = tag_verdict(F.col("genre_tags"), include, [], strict=False)
    flagged = with_priority_flag(df, priority)
    reason = (
        F.when(F.col("has_priority_band"), F.lit("priority_band"))
        .when(F.coalesce(tag, F.lit(False)), F.lit("genre_tag"))
        .when(has_band_keyword(F.col("bands")), F.lit("band_keyword"))
        .when(is_genre_venue(F.col("venue_id")), F.lit("venue"))
        .when(F.col("source").isin(fx.GENRE_SOURCES), F.lit("source"))
        .otherwise(F.lit("default"))
    )
    return flagged.withColumn("reason", reason)


def music_label(title: Column) -> Column:
    """``music``, ``other`` or ``unknown`` from words in a title; music words win."""
    some = text.has_any
    label = lambda low: (
        F.when(some(low, fx.MUSIC_WORDS), F.lit("music")).when(some(low, fx.OTHER_EVENT_WORDS), F.lit("other")).otherwise(F.lit("unknown"))
    )
    return text.bound(F.lower(title), label)


# -- text rules ------------------------------------------------------------------


def contains_any(c: Column, words) -> Column:
    low = F.lower(c)
    return F.exists(text.literal_array(words), lambda w: low.contains(w)) if words else F.lit(False)


def skip_rows(df: DataFrame, column: str, words=(), patterns: Column | None = None) -> DataFrame:
    """Drop rows whose text holds a skip word or matches a pattern of their own list."""
    bad = contains_any(F.col(column), words)
    if patterns is not None:
        bad = bad | F.exists(
            F.coalesce(patterns, F.array().cast("array<string>")),
            lambda p: F.regexp_like(F.lower(F.col(column)), F.concat(F.lit("(?i)"), p)),
        )
    return df.where(~F.coalesce(bad, F.lit(False)))


def active(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("status"), F.lit("")) != "closed")
