"""Text columns: cleaning, keys, slugs, anchors, band lists, prices, ages.

All patterns carry ``(?U)`` so that ``\\w`` and ``\\s`` cover Unicode, the way
listing text (accents, curly quotes, no-break spaces) needs.
"""

from __future__ import annotations

import functools
import json
import operator
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx

U = "(?U)"
UI = "(?iU)"


WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006" + (
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim any Unicode whitespace (plain ``trim`` only knows U+0020)."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_text(c: Column) -> Column:
    """Collapse whitespace runs and strip; NULL becomes the empty string."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def sql_string(value: str) -> str:
    """A value as a Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(pairs: dict) -> Column:
    """A constant map column. For small fixed tables only."""
    lit = lambda v: sql_string(v) if isinstance(v, str) else str(v)
    return F.expr("map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in pairs.items()) + ")")


def literal_array(values) -> Column:
    return F.expr("array(" + ", ".join(sql_string(v) for v in values) + ")")


def bound(value: Column, read) -> Column:
    """``read(value)`` with the value computed once, however often ``read`` uses it."""
    return F.get(F.transform(F.array(value), read), F.lit(0))


def has_any(low: Column, words) -> Column:
    """One of the words occurs in the text; NULL for no text. The text should be :func:`bound`."""
    return functools.reduce(operator.or_, [low.contains(w) for w in words], F.lit(False))


def blank(c: Column) -> Column:
    """True for NULL or the empty string."""
    return c.isNull() | (c == "")


# -- keys --------------------------------------------------------------------


def id_headliner(c: Column) -> Column:
    """Headliner form used inside the stable id."""
    c = F.lower(c)
    c = F.regexp_replace(c, U + fx.ID_CUT_FEATURING, "")
    c = F.regexp_replace(c, UI + fx.ID_CUT_SHOW_SUFFIX, "")
    c = F.regexp_replace(c, U + fx.ID_CUT_YEAR_SUFFIX, "")
    c = F.regexp_replace(c, U + fx.ID_PARENTHESES, " ")
    c = F.regexp_replace(c, r"(?U)[^\w\s]", "")
    c = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return strip(F.substring(c, 1, 30))


def stable_id(date: Column, venue_id: Column, bands: Column, time: Column) -> Column:
    """12 hex digits over date, venue, normalized headliner and time."""
    head = F.when(F.size(bands) > 0, F.element_at(bands, 1)).otherwise(F.lit("unknown"))
    show_time = F.when(blank(time), F.lit("tba")).otherwise(time)
    key = F.concat_ws("|", F.date_format(date, "yyyy-MM-dd"), venue_id, id_headliner(head), show_time)
    return F.substring(F.md5(key), 1, 12)


def resolver_key(c: Column) -> Column:
    """Comparison form of a venue or performer name."""
    c = strip(F.lower(c))
    c = F.regexp_replace(c, U + fx.RESOLVER_LEADING_THE, "")
    c = F.regexp_replace(c, U + fx.RESOLVER_TRAILING_THE, "")
    c = F.regexp_replace(c, UI + fx.RESOLVER_CITY_SUFFIX, "")
    c = F.regexp_replace(c, r"(?U)[^\w\s]", "")
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def band_key(c: Column) -> Column:
    """Grouping key of a performer: case and ``' . ,`` do not matter."""
    return F.translate(strip(F.lower(c)), "'.,", "")


def venue_anchor(c: Column) -> Column:
    return F.substring(F.translate(F.translate(F.lower(c), " ", "_"), "'.,", ""), 1, 30)


def band_anchor(c: Column) -> Column:
    c = F.translate(F.translate(F.lower(c), " ", "_"), "'.,", "")
    c = F.replace(F.replace(c, F.lit("&"), F.lit("and")), F.lit("$"), F.lit("s"))
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_]", ""), 1, 40)


def snapshot_key(c: Column) -> Column:
    """Make a snapshot key safe for paths."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def slug(c: Column, mode: str) -> Column:
    """Slug styles in use by the sources.

    ``api``: drop ``' . ,``, words joined by ``_``, 30 characters.
    ``runs``: every run outside ``a-z0-9`` becomes one ``_``, outer ones trimmed.
    ``solid``: drop everything outside ``a-z0-9``, 20 characters.
    ``line``: drop punctuation, whitespace runs become ``_``.
    ``hyphen``: like ``api`` with `` - `` closed up, words joined by ``-``, full length.
    """
    low = F.lower(c)
    if mode == "api":
        return F.substring(F.regexp_replace(strip(F.translate(low, "'.,", "")), r"(?U)\s+", "_"), 1, 30)
    if mode == "runs":
        return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    if mode == "solid":
        return F.substring(F.regexp_replace(low, "[^a-z0-9]", ""), 1, 20)
    if mode == "line":
        return F.regexp_replace(F.regexp_replace(low, r"(?U)[^\w\s]", ""), r"(?U)\s+", "_")
    if mode == "hyphen":
        closed = F.replace(F.translate(low, "'.,", ""), F.lit(" - "), F.lit("-"))
        return F.regexp_replace(strip(closed), r"(?U)\s+", "-")
    raise ValueError(f"unknown slug mode {mode!r}")


def contains_map(c: Column, table: dict, lowered: bool = False) -> Column:
    """Value of the first pattern, in declared order, that occurs in the lower-cased text."""
    low = c if lowered else F.lower(c)
    return F.coalesce(*[F.when(low.contains(k), F.lit(v)) for k, v in table.items()])


# -- bands -------------------------------------------------------------------


def title_case(c: Column) -> Column:
    """Upper-case after every non-letter, lower-case elsewhere."""
    runs = F.regexp_extract_all(c, F.lit(r"([^\p{L}]+|\p{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), ""
    )


def normalize_bands(bands: Column) -> Column:
    """Strip article and "band" suffix, fix shouting, apply corrections, drop empty names.

    Each step is its own ``transform``: a lambda variable is computed once, while a
    nested expression used twice would be computed twice.
    """
    c = F.transform(F.filter(bands, lambda b: ~blank(b)), strip)
    c = F.transform(c, lambda b: F.regexp_replace(b, UI + fx.BAND_ARTICLE_AND_SUFFIX, "$1"))
    c = F.transform(
        c, lambda b: F.when(F.lower(b).startswith("the "), F.concat(F.lit("The "), F.substring(b, 5, 1 << 30))).otherwise(b)
    )
    shouting = lambda b: (F.upper(b) == b) & (F.lower(b) != b) & (F.length(b) > 4)
    c = F.transform(c, lambda b: F.when(shouting(b), title_case(b)).otherwise(b))
    corrections = literal_map(fx.BAND_CORRECTIONS)
    c = F.transform(c, lambda b: F.coalesce(F.try_element_at(corrections, F.lower(b)), b))
    return F.filter(F.transform(c, strip), lambda b: b != "")


def split_bands(c: Column) -> Column:
    """Split a billing on the usual separators; one-character leftovers are dropped."""
    for sep in fx.BAND_SEPARATORS:
        c = F.replace(c, F.lit(sep), F.lit(", "))
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), clean_text)
    return F.filter(parts, lambda b: F.length(b) > 1)


def split_bands_any_case(c: Column) -> Column:
    """Free-text variant: separators in order, case-insensitive, short names kept."""
    for sep in fx.LINE_BAND_SEPARATORS:
        cased = sep.lower() != sep.upper()
        c = F.regexp_replace(c, f"(?i){sep}", "\x01") if cased else F.replace(c, F.lit(sep), F.lit("\x01"))
    return F.filter(F.transform(F.split(c, "\x01"), strip), lambda b: b != "")


def split_bands_slash(
    c: Column,
    cut: tuple = (),
    words: tuple = ("w/", "with", "&", "and"),
    comma: bool = True,
    max_commas: int | None = None,
    slash_without_spaces: bool = False,
    unquote: bool = False,
) -> Column:
    """Calendar-feed variant: joiner words become `` / ``; that wins over the comma.

    ``cut`` holds patterns removed from the title first. An empty result falls
    back to the whole title.
    """
    t = strip(c)
    if unquote:
        t = F.regexp_replace(F.regexp_replace(t, "'([^']+)'", "$1"), '"([^"]+)"', "$1")
    for pattern in cut:
        t = F.regexp_replace(t, UI + pattern, "")
    if slash_without_spaces:
        t = F.when(t.contains("/") & ~t.contains(" / "), F.replace(t, F.lit("/"), F.lit(" / "))).otherwise(t)
    for word in words:
        t = F.regexp_replace(t, r"(?iU)\s+" + word + r"\s+", " / ")

    def parts(t: Column) -> Column:
        out = F.when(t.contains(" / "), F.split(t, " / "))
        if comma:
            ok = t.contains(",")
            if max_commas is not None:
                ok = t.contains(", ") & (F.regexp_count(t, F.lit(",")) <= max_commas)
            out = out.when(ok, F.split(t, ", " if max_commas is not None else ","))
        kept = F.filter(F.transform(out.otherwise(F.array(t)), strip), lambda b: F.length(b) > 1)
        return bound(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(t)))

    return bound(t, parts)


# -- prices ------------------------------------------------------------------

PRICE_TYPE = "struct<advance:int,door:int>"


def _price(advance: Column, door: Column) -> Column:
    return F.struct(advance.cast("int").alias("advance"), door.cast("int").alias("door"))


def number(c: Column) -> Column:
    """Text as INT, NULL for bad text. The empty text of a missing part is not parsed, which would cost an exception."""
    return bound(c, lambda t: F.when(t != "", t.try_cast("int")))


def whole(c: Column) -> Column:
    """Decimal text truncated to whole currency units; bad text is NULL. Empty text is not parsed."""
    return bound(c, lambda t: F.when(t != "", t.try_cast("double").try_cast("int")))


def parse_price(c: Column, mode: str = "scraper") -> Column:
    """Price text to ``(advance, door)``; 0 is free and NULL unknown.

    ``scraper``: "free" is (0,0); first two amounts, one amount fills both.
    ``line``: ``$a`` or ``$a/$d``; a missing door stays NULL.
    ``pair``: ``$a`` or ``$a/$d``; a missing door repeats the advance.
    ``free_pair``: as ``pair`` after a check for free words.
    ``words``: ``$a adv`` and ``$d door`` around free text, "free" before any ``$`` wins.
    ``cost``: a bare cost where empty or 0 is free.
    """
    none = F.lit(None)
    zero = _price(F.lit(0), F.lit(0))
    text = F.coalesce(c, F.lit(""))
    low = F.lower(text)
    if mode == "scraper":
        low = strip(low)

        def amounts(t: Column) -> Column:
            nums = F.transform(F.regexp_extract_all(t, F.lit(fx.AMOUNT), F.lit(1)), whole)
            pair = bound(nums, lambda n: _price(F.get(n, F.lit(0)), F.coalesce(F.get(n, F.lit(1)), F.get(n, F.lit(0)))))
            return F.when(t.contains("free"), zero).otherwise(pair)

        return bound(low, amounts)
    if mode in ("line", "pair", "free_pair"):
        pattern = r"\$(\d+)(?:[/-]\$?(\d+))?" if mode == "line" else r"\$(\d+)(?:\s*/\s*\$?(\d+))?"
        amount = lambda m, i: whole(F.regexp_extract(m, pattern, i))
        door = (lambda p: p["door"]) if mode == "line" else (lambda p: F.coalesce(p["door"], p["advance"]))
        read = lambda m: F.struct(amount(m, 1).alias("advance"), amount(m, 2).alias("door"))
        pair = lambda m: bound(read(m), lambda p: _price(p["advance"], door(p)))
        # The text is searched once, its amounts are read from what was found.
        out = bound(F.regexp_extract(text, pattern, 0), lambda m: F.when(m != "", pair(m)).otherwise(_price(none, none)))
        return F.when(is_free_text(text), zero).otherwise(out) if mode == "free_pair" else out
    if mode == "words":
        found = {
            "adv": r"\$(\d+)\s*(?:in advance|adv)", "door": r"\$(\d+)\s*(?:at the door|door|dos)", "single": r"\$(\d+)",
        }
        read = lambda t: F.struct(*[whole(F.regexp_extract(t, p, 1)).alias(n) for n, p in found.items()])
        pair = lambda p: _price(F.coalesce(p["adv"], p["door"], p["single"]), F.coalesce(p["door"], p["adv"], p["single"]))
        free_first = lambda t: F.element_at(F.split(t, r"\$"), 1).contains("free")
        return bound(low, lambda t: F.when(free_first(t), zero).otherwise(bound(read(t), pair)))
    if mode == "cost":
        price = whole(text)
        return F.when((text == "") | (text == "0"), zero).otherwise(_price(price, price))
    raise ValueError(f"unknown price mode {mode!r}")


def is_free_text(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for word in fx.FREE_WORDS:
        out = out | low.contains(word)
    return out


def price_display(advance: Column, door: Column) -> Column:
    """``$a/$d``, ``$x`` or empty; 0 counts as absent."""
    a = F.coalesce(advance, F.lit(0)) != 0
    d = F.coalesce(door, F.lit(0)) != 0
    adv, dr = F.concat(F.lit("$"), advance.cast("string")), F.concat(F.lit("$"), door.cast("string"))
    return F.when(a & d, F.concat(adv, F.lit("/"), dr)).when(a, adv).when(d, dr).otherwise(F.lit(""))


def is_free(advance: Column, door: Column) -> Column:
    return (F.coalesce(advance, F.lit(-1)) == 0) | (F.coalesce(door, F.lit(-1)) == 0)


# -- age, flags, markup ----------------------------------------------------------


def normalize_age(c: Column) -> Column:
    low = strip(F.lower(F.coalesce(c, F.lit(""))))
    return (
        F.when(low.contains("all") | (low == "aa"), F.lit("a/a"))
        .when(low.contains("21"), F.lit("21+"))
        .when(low.contains("18"), F.lit("18+"))
        .otherwise(F.lit(fx.DEFAULT_AGE))
    )


def parse_age(c: Column, mode: str = "scraper") -> Column:
    """Age text. ``scraper`` matches loosely, ``words`` asks for "21+" or "21 and over"."""
    low = strip(F.lower(F.coalesce(c, F.lit(""))))
    if mode == "scraper":
        return (
            F.when(low.contains("all age") | (low == "aa") | low.contains("a/a"), F.lit("a/a"))
            .when(low.contains("21"), F.lit("21+"))
            .when(low.contains("18"), F.lit("18+"))
            .otherwise(F.lit(fx.DEFAULT_AGE))
        )
    if mode in ("words", "words_or_18"):
        every = low.contains("all ages")
        if mode == "words_or_18":
            every = every | low.contains("a/a")
        return (
            F.when(every, F.lit("a/a"))
            .when(low.contains("21+") | low.contains("21 and over"), F.lit("21+"))
            .when(low.contains("18+") | low.contains("18 and over"), F.lit("18+"))
            .otherwise(F.lit("21+" if mode == "words" else "18+"))
        )
    if mode == "grammar":
        return (
            F.when(low.contains("21+"), F.lit("21+"))
            .when(low.contains("18+"), F.lit("18+"))
            .when(low.contains("16+"), F.lit("16+"))
            .otherwise(F.lit(fx.DEFAULT_AGE))
        )
    raise ValueError(f"unknown age mode {mode!r}")


def sorted_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def html_escape(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


# The standard's named references, with and (the old ones) without a closing semicolon.
# By first letter: a map column is searched from its start, so one map of all names would cost as many comparisons.
_NAMED = json.dumps(
    {first: {k[:-1]: v for k, v in html5.items() if k.endswith(";") and k[0] == first} for first in sorted({k[0] for k in html5})}
)
_WINDOWS = json.dumps({k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160)})
_OPEN = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))


def _character(code: Column) -> Column:
    """The character of a code point; the standard reads 128 to 159 as Windows-1252, and 0, surrogates and codes out of range as U+FFFD."""
    bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF) | code.isNull()
    old = code.between(128, 159)
    windows = F.try_element_at(F.from_json(F.lit(_WINDOWS), "map<string,string>"), code.cast("string"))
    wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(bad, F.lit("\ufffd")).when(old, windows).otherwise(wide)


def _references(c: Column, shown) -> Column:
    """References replaced by ``shown(character)``. A large expression: evaluate it once per text."""

    def piece(x: Column) -> Column:
        named = F.regexp_extract(x, "^&([A-Za-z][A-Za-z0-9]*);", 1)
        opened = F.regexp_extract(x, "^&(" + "|".join(_OPEN) + ")", 1)
        digits = F.regexp_extract(x, r"^&#(\d+);?", 1)
        hexed = F.regexp_extract(x, "^&#[xX]([0-9a-fA-F]+);?", 1)
        number = lambda d, base: F.try_to_number(F.conv(F.when(F.length(F.ltrim(d, F.lit("0"))) > 9, F.lit("7fffffff" if base == 16 else "2147483647")).otherwise(d), base, 10), F.lit("9999999999")).cast("bigint")
        rest = lambda pattern: F.regexp_replace(x, pattern, "")
        table = F.from_json(F.lit(_NAMED), "map<string,map<string,string>>")  # a constant: folded into one literal map
        find = lambda name: F.try_element_at(F.try_element_at(table, F.substring(name, 1, 1)), name)
        return (
            F.when(~x.startswith("&"), x)
            .when(digits != "", F.concat(shown(_character(number(digits, 10))), rest(r"^&#\d+;?")))
            .when(hexed != "", F.concat(shown(_character(number(hexed, 16))), rest("^&#[xX][0-9a-fA-F]+;?")))
            .otherwise(
                F.coalesce(
                    bound(find(named), lambda known: F.when(known.isNotNull(), F.concat(shown(known), rest("^&[A-Za-z0-9]+;")))),
                    bound(opened, lambda o: F.when(o != "", F.concat(shown(find(o)), F.substr(x, F.length(o) + 2)))),
                    x,
                )
            )
        )

    decoded = lambda t: F.array_join(F.transform(F.split(t, "(?=&)"), piece), "")
    return bound(c, lambda t: F.when(~t.contains("&"), t).otherwise(decoded(t)))


def html_unescape(c: Column) -> Column:
    """Every character reference decoded once: named, decimal and hexadecimal."""
    return _references(c, lambda x: x)


def settle_references(c: Column) -> Column:
    """References decoded but for those of markup characters, which become their short names.

    Markup can still be cut by its tags, and ``basic_unescape`` then finishes the parts.
    """
    return _references(c, html_escape)


def basic_unescape(c: Column) -> Column:
    """The references that ``settle_references`` and ``html_escape`` leave, decoded. A small expression."""
    for entity, raw in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"),
        ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
    ):
        c = F.replace(c, F.lit(entity), F.lit(raw))
    return c


def unescape_ical(c: Column) -> Column:
    for escaped, raw in (("\\n", "\n"), ("\\,", ","), ("\\;", ";"), ("\\:", ":"), ("\\\\", "\\")):
        c = F.replace(c, F.lit(escaped), F.lit(raw))
    return c


def listing_line(
    venue_id: Column, venue_name: Column, venue_location: Column, bands: Column, age: Column,
    advance: Column, door: Column, time: Column, flags: Column, source_url: Column, links: bool = True,
) -> Column:
    """One listing as an escaped line: venue, city, bands, age, price, time, flags."""
    place = F.concat(html_escape(venue_name), F.lit(", "), html_escape(venue_location))
    bold = F.concat(F.lit("<b>"), place, F.lit("</b>"))
    if links:
        venue = F.concat(F.lit('<a href="by-club.html#'), venue_anchor(venue_id), F.lit('">'), bold, F.lit("</a>"))
        names = F.transform(
            bands,
            lambda b: F.concat(
                F.lit('<a href="by-band.html#'), band_anchor(b), F.lit('">'), html_escape(b), F.lit("</a>")
            ),
        )
    else:
        venue, names = bold, F.transform(bands, html_escape)
    price = price_display(advance, door)
    details = F.concat_ws(" ", html_escape(age), F.when(price != "", html_escape(price)), html_escape(time))
    flag_text = F.when(F.size(flags) > 0, F.array_join(F.transform(flags, html_escape), " "))
    line = F.concat_ws(" ", venue, F.when(F.size(bands) > 0, F.array_join(names, ", ")), details, flag_text)
    if not links:
        return line
    return F.when(
        ~blank(source_url), F.concat(line, F.lit('&nbsp;<a href="'), html_escape(source_url), F.lit('">→</a>'))
    ).otherwise(line)
