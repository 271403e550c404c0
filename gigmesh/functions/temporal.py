"""Date and time columns. ``as_of`` is always an argument: no clock is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions.text import blank, bound, literal_map, strip

DAY = "yyyy-MM-dd"


def day(c: Column) -> Column:
    return F.to_date(c)


def as_date(value) -> Column:
    return value if isinstance(value, Column) else F.to_date(F.lit(str(value)))


# -- clock text --------------------------------------------------------------


def _hour_minute_suffix(c: Column, pattern: str):
    low = strip(F.lower(c))
    hour = F.regexp_extract(low, pattern, 1).try_cast("int")
    minute = F.regexp_extract(low, pattern, 2)
    suffix = F.regexp_extract(low, pattern, 3)
    return hour, F.when(minute == "", F.lit(0)).otherwise(minute.try_cast("int")), suffix


def time_to_minutes(c: Column, default: int = -1, pattern: str = fx.CLOCK_ANCHORED) -> Column:
    """Minutes after midnight from a leading clock text, else ``default``."""
    hour, minute, suffix = _hour_minute_suffix(F.coalesce(c, F.lit("")), pattern)
    h24 = (
        F.when((suffix == "pm") & (hour != 12), hour + 12)
        .when((suffix == "am") & (hour == 12), F.lit(0))
        .otherwise(hour)
    )
    return F.coalesce(h24 * 60 + minute, F.lit(default))


def time_sort_key(c: Column) -> Column:
    """Sort key of a show time; unknown sorts as 1200."""
    return time_to_minutes(c, default=1200, pattern=fx.CLOCK_SORT)


def normalize_time(c: Column) -> Column:
    """Compact show time. Without am/pm the minutes are lost and pm is assumed."""
    t = F.replace(strip(F.lower(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit(""))
    hour = F.regexp_extract(t, r"^(\d+)", 1).try_cast("int")
    assumed = F.concat(F.when(hour < 12, hour).otherwise(hour - 12).cast("string"), F.lit("pm"))
    t = F.when(t.contains("am") | t.contains("pm") | hour.isNull(), t).otherwise(assumed)
    return F.when(blank(c), F.lit(fx.DEFAULT_TIME)).otherwise(F.replace(t, F.lit(":00"), F.lit("")))


def parse_time(c: Column) -> Column:
    """First clock in the text as ``h[am|pm]``; minutes dropped, pm assumed."""

    def shown(m: Column) -> Column:
        hour, suffix = m["hour"], m["suffix"]
        return (
            F.when(hour.isNull(), F.lit(fx.DEFAULT_TIME))
            .when(hour > 12, F.concat((hour - 12).cast("string"), F.lit("pm")))
            .when(hour == 0, F.lit("12am"))
            .otherwise(F.concat(hour.cast("string"), F.when(suffix == "", F.lit("pm")).otherwise(suffix)))
        )

    read = lambda low: F.struct(F.regexp_extract(low, fx.CLOCK, 1).try_cast("int").alias("hour"), F.regexp_extract(low, fx.CLOCK, 3).alias("suffix"))
    return bound(bound(strip(F.lower(F.coalesce(c, F.lit("")))), read), shown)


def parse_time_minutes(c: Column, default: str = fx.DEFAULT_TIME) -> Column:
    """First ``h[:mm] am/pm`` in the text, ``:00`` left out; other text gives the default."""
    pattern = r"(\d{1,2})(?::(\d{2}))?\s*(am|pm)"

    def shown(found: Column) -> Column:
        hour, minute, suffix = (F.regexp_extract(found, pattern, i) for i in (1, 2, 3))
        minutes = bound(minute, lambda m: F.when((m != "") & (m != "00"), F.concat(F.lit(":"), m)).otherwise(""))
        return F.when(found == "", F.lit(default)).otherwise(F.concat(hour, minutes, suffix))

    return bound(F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), pattern, 0), shown)


def clock_label(ts: Column, minutes: bool = True) -> Column:
    """Wall-clock label of a timestamp: ``7pm``, ``7:30pm``."""
    whole = F.lower(F.date_format(ts, "ha"))
    if not minutes:
        return whole
    return F.when(F.minute(ts) == 0, whole).otherwise(F.lower(F.date_format(ts, "h:mma")))


def minutes_similar(ma: Column, mb: Column, a: Column, b: Column) -> Column:
    """Within an hour, never across midnight; unparsable times compare as text."""
    return F.when((ma < 0) | (mb < 0), F.lower(a) == F.lower(b)).otherwise(
        F.abs(ma - mb) <= fx.SAME_SHOW_MINUTES
    )


def times_similar(a: Column, b: Column) -> Column:
    return minutes_similar(time_to_minutes(a), time_to_minutes(b), a, b)


def event_time(day_col: Column, time: Column) -> Column:
    """Day plus the clock in ``time`` (pm assumed, 20:00 when unreadable)."""
    hour, minute, suffix = _hour_minute_suffix(time, fx.CLOCK_ANCHORED)
    period = F.when(suffix == "", F.lit("pm")).otherwise(suffix)
    h24 = (
        F.when((period == "pm") & (hour < 12), hour + 12)
        .when((period == "am") & (hour == 12), F.lit(0))
        .otherwise(hour)
    )
    h24 = F.coalesce(h24, F.lit(20))
    return F.to_timestamp_ntz(
        F.concat(F.date_format(day_col, DAY), F.format_string(" %02d:%02d:00", h24, F.coalesce(minute, F.lit(0)))),
        F.lit("yyyy-MM-dd HH:mm:ss"),
    )


# -- calendar ----------------------------------------------------------------


def week_start(c: Column) -> Column:
    return F.to_date(F.date_trunc("week", c))


def week_end(c: Column) -> Column:
    return F.date_add(week_start(c), 6)


def week_number(c: Column, as_of) -> Column:
    """Whole weeks after the week of ``as_of``; earlier weeks clamp to 0."""
    diff = F.datediff(week_start(c), week_start(as_date(as_of)))
    return F.greatest(F.lit(0), F.floor(diff / 7).cast("int"))


def week_label(start: Column, end: Column) -> Column:
    return F.concat(F.date_format(start, "MMM d"), F.lit(" - "), F.date_format(end, "MMM d"))


def adjusted_week_label(c: Column, as_of) -> Column:
    """Week label that starts today when today lies inside the week."""
    start, end, today = week_start(c), week_end(c), as_date(as_of)
    shown = F.when((today >= start) & (today <= end), today).otherwise(start)
    return week_label(shown, end)


def format_date(c: Column, style: str = "short") -> Column:
    return F.date_format(c, {"short": "EEE MMM d", "long": "EEEE, MMMM d, yyyy", "iso": DAY}.get(style, "EEE MMM d"))


DATE_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "M/d/yy",
    "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy",
    "MM-dd-yyyy", "yyyyMMdd",
]
YEARLESS_FORMATS = ["MMMM d yyyy", "MMM d yyyy", "M/d yyyy"]


def parse_date(c: Column, default_year: int | None = None, formats=None, now_year: int | None = None) -> Column:
    """Free date text by an explicit format list; leading weekday names are ignored.

    Text without a year takes ``now_year`` (or ``default_year``). A parsed year
    before 2020 is replaced by ``default_year`` when one is given.
    """
    text = strip(F.regexp_replace(c, r"(?i)^\s*(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""))
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in (formats or DATE_FORMATS)]
    year = now_year or default_year
    if year is not None:
        dated = F.concat(text, F.lit(f" {year}"))
        tries += [F.try_to_timestamp(dated, F.lit(f)) for f in YEARLESS_FORMATS]
    out = F.coalesce(*tries).cast("timestamp_ntz")
    if default_year is None:
        return out
    moved = out + F.make_ym_interval(F.lit(default_year) - F.year(out), F.lit(0))
    return F.when(F.year(out) < 2020, moved).otherwise(out)


YEAR_RULES = {
    "two_weeks": 14,
    "one_week": 7,
    "one_month": 30,
    "any_past": 0,
}


def date_or_null(year: Column, month: Column, day_of_month: Column) -> Column:
    """A date of the years 0 to 9999, NULL when there is no such day. No text is formed or parsed, so a wrong date costs no exception."""

    def read(p: Column) -> Column:
        y, m, d = p["y"], p["m"], p["d"]
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        last = F.get(F.array(*[F.lit(n) for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]), m - 1)
        known = (y >= 0) & (y <= 9999) & (d >= 1) & ((d <= last) | (leap & (m == 2) & (d == 29)))
        return F.when(known, F.make_date(y, m, d))

    return bound(F.struct(year.alias("y"), month.alias("m"), day_of_month.alias("d")), read)


def infer_year(month: Column, day_of_month: Column, as_of, rule: str) -> Column:
    """Date for a month and day without a year; NULL when no such day exists.

    Rules: ``two_weeks``, ``one_week``, ``one_month`` and ``any_past`` move dates
    lying more than 14, 7, 30 or 0 days back into next year; ``earlier_month``
    looks at the month alone; ``none`` keeps the year of ``as_of``.
    """
    today = as_date(as_of)
    if rule == "none":
        return date_or_null(F.year(today), month, day_of_month)

    def read(p: Column) -> Column:
        in_year = lambda year: date_or_null(year, p["m"], p["d"])
        if rule == "earlier_month":
            return in_year(F.when(p["m"] < F.month(today), F.year(today) + 1).otherwise(F.year(today)))
        later = lambda this_year: F.datediff(today, this_year) > YEAR_RULES[rule]
        return bound(in_year(F.year(today)), lambda d: F.when(later(d), in_year(F.year(today) + 1)).otherwise(d))

    # Month and day are computed once; nothing is read where one is missing.
    parts = F.struct(month.alias("m"), day_of_month.alias("d"))
    return bound(parts, lambda p: F.when(p["m"].isNotNull() & p["d"].isNotNull(), read(p)))


def month_number(name: Column) -> Column:
    """Month number of an English month name or its usual short form."""
    return F.try_element_at(literal_map(fx.MONTHS), F.lower(name))


def utc_to_eastern(ts: Column) -> Column:
    """UTC wall time to US Eastern wall time, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts)


def strip_tz(iso: Column) -> Column:
    """Wall time of an ISO text, its offset ignored."""
    return F.to_timestamp_ntz(F.substring(iso, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
