"""Hand-written listing lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions import temporal, text
from gigmesh.functions.text import strip
from gigmesh.schema import as_listings

C = F.col

# Patterns (fixed values).
PRICE = r"\$(\d+)(?:[/-]\$?(\d+))?"
AGES = [(r"\b21\+", "21+"), (r"\b18\+", "18+"), (r"\ba/a\b", "a/a"), (r"\ball\s*ages\b", "a/a")]
CLOCK = r"\b(\d{1,2}):?(\d{2})?\s*(am|pm)\b"
CLOCK_24 = r"\b(\d{1,2}):(\d{2})\b"
SLASH_DATE = r"\b(\d{1,2})/(\d{1,2})\b"
NAMED_DATE = r"\b(" + "|".join(fx.MONTHS) + r")\s+(\d{1,2})\b"


def _cut(c: Column, pattern: str) -> Column:
    """Remove the first match of ``pattern`` and strip."""
    return strip(F.regexp_replace(c, r"(?is)^(.*?)" + pattern, "$1"))


def _with_minutes(hour: Column, minute: Column, suffix: Column) -> Column:
    shown = F.when((minute != "") & (minute != "00"), F.concat(F.lit(":"), minute)).otherwise(F.lit(""))
    return F.concat(hour, shown, suffix)


def parse_lines(df: DataFrame, line: str = "line", as_of="1970-01-01") -> DataFrame:
    """Add the parsed fields of a line as struct ``parsed``.

    Price, age, time and date are found and removed in this order; what is left is
    ``bands <separator> venue[, location]``.
    """
    rest = strip(C(line))
    out = df.withColumn("__p", rest)
    out = out.withColumn("__price", text.parse_price(C("__p"), "line")).withColumn("__a", _cut(C("__p"), PRICE))

    # Each text is searched once: later steps use what was found, and no missing part is parsed.
    first = F.coalesce(*[F.when(C("__a").rlike("(?i)" + pattern), F.lit(k)) for k, (pattern, _) in enumerate(AGES)])
    out = out.withColumn("__k", first)
    age, after = F.lit(fx.DEFAULT_AGE), C("__a")
    for k, (pattern, value) in enumerate(AGES):
        age = F.when(C("__k") == k, F.lit(value)).otherwise(age)
        after = F.when(C("__k") == k, _cut(C("__a"), pattern)).otherwise(after)
    out = out.withColumn("__age", age).withColumn("__t", strip(after))

    t = C("__t")
    ci, h24 = "(?i)" + CLOCK, CLOCK_24
    out = out.withColumn("__twelve", F.regexp_extract(t, ci, 0))
    out = out.withColumn("__full", F.when(C("__twelve") == "", F.regexp_extract(t, h24, 0)).otherwise(F.lit("")))
    twelve, full = C("__twelve"), C("__full")
    shown = _with_minutes(F.regexp_extract(twelve, ci, 1), F.regexp_extract(twelve, ci, 2), F.lower(F.regexp_extract(twelve, ci, 3)))
    hour = F.regexp_extract(full, h24, 1).try_cast("int")
    display = F.when(hour > 12, hour - 12).otherwise(hour).cast("string")
    shown24 = _with_minutes(display, F.regexp_extract(full, h24, 2), F.when(hour >= 12, F.lit("pm")).otherwise(F.lit("am")))
    out = out.withColumn(
        "__time", F.when(twelve != "", shown).when(full != "", shown24).otherwise(F.lit(fx.DEFAULT_TIME))
    ).withColumn("__d", F.when(twelve != "", _cut(t, CLOCK)).when(full != "", _cut(t, CLOCK_24)).otherwise(t))

    d = C("__d")
    named_ci = "(?i)" + NAMED_DATE
    slash = lambda m: temporal.infer_year(
        F.regexp_extract(m, SLASH_DATE, 1).try_cast("int"), F.regexp_extract(m, SLASH_DATE, 2).try_cast("int"), as_of, "two_weeks"
    )
    named = lambda m: temporal.infer_year(
        temporal.month_number(F.regexp_extract(m, named_ci, 1)), F.regexp_extract(m, named_ci, 2).try_cast("int"), as_of, "two_weeks"
    )
    found = lambda pattern, read: text.bound(F.regexp_extract(d, pattern, 0), lambda m: F.when(m != "", read(m)))
    out = out.withColumn("__slash", found(SLASH_DATE, slash))
    out = out.withColumn("__named", F.when(C("__slash").isNull(), found(named_ci, named)))
    out = out.withColumn(
        "__r",
        F.when(C("__slash").isNotNull(), _cut(d, SLASH_DATE)).when(C("__named").isNotNull(), _cut(d, NAMED_DATE)).otherwise(d),
    )

    r = C("__r")
    out = out.withColumn("__low", F.lower(r))
    sep = F.coalesce(*[F.when(C("__low").contains(s), F.lit(s)) for s in fx.LINE_VENUE_SEPARATORS])
    out = out.withColumn("__sep", sep).withColumn("__at", F.instr(C("__low"), C("__sep")))
    at = C("__at")
    bands = F.when(at > 0, strip(F.substring(r, F.lit(1), at - 1))).otherwise(F.lit(""))
    venue = F.when(at > 0, strip(F.substring(r, at + F.length("__sep"), F.lit(1 << 30)))).otherwise(r)
    out = out.withColumn("__bands", bands).withColumn("__venue", strip(venue))
    v = C("__venue")
    place = strip(F.regexp_replace(F.substring_index(v, ",", -1), r"(?i)\s+MA$", ""))
    parsed = F.struct(
        text.split_bands_any_case(C("__bands")).alias("bands"),
        F.when(v.contains(","), strip(F.regexp_extract(v, r"(?s)^(.*),", 1))).otherwise(v).alias("venue"),
        F.when(v.contains(","), place).otherwise(F.lit("")).alias("location"),
        F.coalesce("__slash", "__named").alias("date"),
        C("__time").alias("time"),
        C("__price.advance").alias("price_advance"),
        C("__price.door").alias("price_door"),
        C("__age").alias("age_requirement"),
        C("__p").alias("raw_text"),
    )
    return out.withColumn("parsed", parsed).drop(
        "__p", "__price", "__a", "__k", "__age", "__t", "__twelve", "__full", "__time", "__d", "__slash", "__named", "__r",
        "__low", "__sep", "__at", "__bands", "__venue"
    )


def venue_id(name: Column) -> Column:
    known = F.try_element_at(text.literal_map(fx.LINE_VENUE_IDS), strip(F.lower(name)))
    return F.when(text.blank(name), F.lit("unknown")).otherwise(F.coalesce(known, text.slug(name, "line")))


def line_listings(df: DataFrame, line: str = "line", as_of="1970-01-01") -> DataFrame:
    """Lines as listings; an undated line is for today, an unplaced one for the home city."""
    p = parse_lines(df, line, as_of)
    today = temporal.as_date(as_of)
    return as_listings(
        p,
        date=F.coalesce("parsed.date", today).cast("timestamp_ntz"),
        venue_id=venue_id(C("parsed.venue")),
        venue_name=C("parsed.venue"),
        venue_location=F.when(text.blank(C("parsed.location")), F.lit(fx.DEFAULT_LOCATION)).otherwise(C("parsed.location")),
        bands=C("parsed.bands"),
        age_requirement=C("parsed.age_requirement"),
        price_advance=C("parsed.price_advance"),
        price_door=C("parsed.price_door"),
        time=C("parsed.time"),
        source=F.lit("manual"),
    )
