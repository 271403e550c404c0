"""Fuzzy name similarity: columns, and the same measures of plain strings.

Columns work in the JVM: the longest common subsequence is bit-parallel, in words of ``WORD`` bits
inside ``aggregate``. The plain functions (one big-integer word of any length) serve the billing
fold and SQL.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gigmesh import fixed_values as fx

def lcs_of(a: str, b: str) -> int:
    """LCS length of two strings of any length, one big-integer word."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratio(lcs: int, la: int, lb: int) -> float:
    return 100.0 * 2 * lcs / (la + lb) if la + lb else 100.0


def ratio_of(a: str, b: str) -> float:
    return _ratio(len(a) if a == b else lcs_of(a, b), len(a), len(b))


@lru_cache(maxsize=100_000)
def partial_of(a: str, b: str) -> float:
    """Best ratio of the shorter string against a window of the longer one.

    Windows have the shorter length, or overhang either end of the longer string.
    """
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    best = _partial_one_way(a, b)
    return max(best, _partial_one_way(b, a)) if len(a) == len(b) else best


def _partial_one_way(short: str, long: str) -> float:
    n, m = len(short), len(long)
    spans = [(0, i) for i in range(1, n)]
    spans += [(i, i + n) for i in range(m - n)]
    spans += [(i, m) for i in range(m - n, m)]
    return max(ratio_of(short, long[i:j]) for i, j in spans)


@lru_cache(maxsize=100_000)
def token_set_of(a: str, b: str) -> float:
    """Ratio over token sets; shared tokens count fully, order does not matter."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    both, only_a, only_b = ta & tb, " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))
    if both and (not only_a or not only_b):
        return 100.0
    shared = len(" ".join(both))
    gap = 1 if shared else 0
    full_a, full_b = shared + gap + len(only_a), shared + gap + len(only_b)
    edits = len(only_a) + len(only_b) - 2 * lcs_of(only_a, only_b)
    best = 100.0 * (1 - edits / (full_a + full_b))
    if shared:
        for full, only in ((full_a, only_a), (full_b, only_b)):
            best = max(best, 100.0 * (1 - (gap + len(only)) / (shared + full)))
    return best


# -- columns ----------------------------------------------------------------------

#: Bits of a word of the longest common subsequence; a sum of two words and a carry stays positive.
WORD = 62


def _shifted(by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), by.cast("int"))


def _or_all(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda s, v: s.bitwiseOR(v))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed, and planned, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _state(m: Column, full: Column, row: Column) -> Column:
    return F.struct(m.alias("m"), full.alias("full"), row.alias("row"))


def _lcs_one_word(chars: Column, others: Column) -> Column:
    """For at most ``WORD`` ``chars``: a bit per character, set while it is not matched."""
    place = lambda c: _or_all(F.transform(chars, lambda x, i: F.when(x == c, _shifted(i)).otherwise(F.lit(0).cast("bigint"))))
    places = F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("c"), place(c).alias("bits"))))

    def step(s: Column, c: Column) -> Column:
        hit = s["row"].bitwiseAND(F.coalesce(F.try_element_at(s["m"], c), F.lit(0).cast("bigint")))
        return _state(s["m"], s["full"], (s["row"] + hit).bitwiseOR(s["row"] - hit).bitwiseAND(s["full"]))

    start = _let(_shifted(F.size(chars)) - 1, lambda full: _state(places, full, full))
    return F.aggregate(others, start, step, lambda s: F.bit_count(s["full"]) - F.bit_count(s["row"]))


def _lcs_words(chars: Column, others: Column) -> Column:
    """The same with as many words as ``chars`` need, and a carry between them."""
    zero = F.lit(0).cast("bigint")
    spans = F.sequence(F.lit(0), F.floor((F.size(chars) - 1) / WORD).cast("int"))
    part = lambda w: F.slice(chars, w * WORD + 1, F.lit(WORD))
    place = lambda c: F.transform(spans, lambda w: _or_all(F.transform(part(w), lambda x, i: F.when(x == c, _shifted(i)).otherwise(zero))))
    places = F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("c"), place(c).alias("bits"))))
    begun = F.struct(F.array().cast("array<bigint>").alias("row"), zero.alias("carry"))

    def step(s: Column, c: Column) -> Column:
        def word(t: Column, bits: Column, w: Column, hits: Column) -> Column:
            def moved(x: Column) -> Column:
                row = x["total"].bitwiseOR(bits - x["hit"]).bitwiseAND(F.get(s["full"], w))
                return F.struct(F.concat(t["row"], F.array(row)).alias("row"), F.call_function("shiftright", x["total"], F.lit(WORD)).alias("carry"))

            return _let(bits.bitwiseAND(F.get(hits, w)), lambda hit: _let(F.struct(hit.alias("hit"), (bits + hit + t["carry"]).alias("total")), moved))

        def row(hits: Column) -> Column:
            numbered = F.transform(s["row"], lambda bits, w: F.struct(bits.alias("bits"), w.alias("w")))
            return F.aggregate(numbered, begun, lambda t, x: word(t, x["bits"], x["w"], hits), lambda t: t["row"])

        return _let(F.try_element_at(s["m"], c), lambda hits: _state(s["m"], s["full"], F.when(hits.isNull(), s["row"]).otherwise(row(hits))))

    ones = lambda words: F.aggregate(words, F.lit(0), lambda n, v: n + F.bit_count(v))
    start = _let(F.transform(spans, lambda w: _shifted(F.size(part(w))) - 1), lambda full: _state(places, full, full))
    return F.aggregate(others, start, step, lambda s: ones(s["full"]) - ones(s["row"]))


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, bit-parallel; NULL if a side is."""
    pair = F.when(F.length(a) <= F.length(b), F.struct(a.alias("short"), b.alias("long"))).otherwise(F.struct(b.alias("short"), a.alias("long")))
    split = lambda p: F.struct(p["short"].alias("short"), F.split(p["short"], "").alias("x"), F.split(p["long"], "").alias("y"))
    return _let(pair, lambda p: _let(split(p), lambda s: (
        F.when(s["short"] == "", F.when(s["y"].isNotNull(), F.lit(0))).when(F.size(s["x"]) <= WORD, _lcs_one_word(s["x"], s["y"]))
        .when(s["x"].isNotNull() & s["y"].isNotNull(), _lcs_words(s["x"], s["y"]))
    )))


def indel_ratio(a: Column, b: Column) -> Column:
    """Ratio of 0 to 100; NULL if a side is."""
    a, b = _columns(a, b)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).when(a == b, F.lit(100.0)).otherwise(lcs(a, b) * F.lit(200.0) / total)


def _columns(*cols) -> tuple[Column, ...]:
    return tuple(F.col(c) if isinstance(c, str) else c for c in cols)


def _windows(short: Column, long: Column) -> Column:
    """Windows of ``long`` as wide as ``short``, and those that overhang an end."""
    n, m = F.length(short), F.length(long)
    none = F.array().cast("array<int>")
    numbers = lambda first, last: F.when(first <= last, F.sequence(first, last)).otherwise(none)
    return F.concat(
        F.transform(numbers(F.lit(1), n - 1), lambda i: F.substr(long, F.lit(1), i)),
        F.transform(numbers(F.lit(1), m - n), lambda i: F.substr(long, i, n)),
        F.transform(numbers(m - n + 1, m), lambda i: F.substr(long, i)),
    )


def partial_ratio(a: Column, b: Column) -> Column:
    """Best ratio of the shorter string against a window of the longer one; NULL if a side is."""
    pair = F.struct(*[c.alias(n) for n, c in zip("ab", _columns(a, b), strict=True)])
    cut = lambda x, y: F.transform(_windows(x, y), lambda w: F.struct(x.alias("x"), w.alias("w")))
    ratio = lambda p: lcs(p["x"], p["w"]) * F.lit(200.0) / (F.length(p["x"]) + F.length(p["w"]))

    def best(p: Column) -> Column:
        a, b, la, lb = p["a"], p["b"], F.length(p["a"]), F.length(p["b"])
        none = F.array().cast("array<struct<x:string,w:string>>")
        cuts = F.concat(F.when(la <= lb, cut(a, b)).otherwise(none), F.when(la >= lb, cut(b, a)).otherwise(none))
        return (
            F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((la == 0) & (lb == 0), F.lit(100.0)).when((la == 0) | (lb == 0), F.lit(0.0))
            .when(b.contains(a) | a.contains(b), F.lit(100.0)).otherwise(F.array_max(F.transform(cuts, ratio)))
        )

    return _let(pair, best)


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != ""))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Ratio over token sets: shared tokens count fully, order does not matter; NULL if a side is."""
    a, b = _columns(a, b)
    text = lambda tokens: F.array_join(F.array_sort(tokens), " ")

    def sides(t: Column) -> Column:
        return F.struct(
            (F.size(t["a"]) > 0).alias("any_a"), (F.size(t["b"]) > 0).alias("any_b"), F.length(text(F.array_intersect(t["a"], t["b"]))).alias("shared"),
            text(F.array_except(t["a"], t["b"])).alias("only_a"), text(F.array_except(t["b"], t["a"])).alias("only_b"),
        )

    def ratio(t: Column) -> Column:
        shared, rest_a, rest_b = t["shared"], F.length(t["only_a"]), F.length(t["only_b"])
        gap = F.when(shared > 0, 1).otherwise(0)
        joined = 100.0 * (1 - (rest_a + rest_b - 2 * lcs(t["only_a"], t["only_b"])) / (2 * (shared + gap) + rest_a + rest_b))
        against = lambda rest: F.when(shared > 0, 100.0 * (1 - (gap + rest) / (2 * shared + gap + rest)))
        return (
            F.when(~t["any_a"] | ~t["any_b"], F.lit(0.0)).when((shared > 0) & ((rest_a == 0) | (rest_b == 0)), F.lit(100.0))
            .otherwise(F.greatest(joined, against(rest_a), against(rest_b)))
        )

    known = F.when(a.isNotNull() & b.isNotNull(), F.struct(_tokens(a).alias("a"), _tokens(b).alias("b")))
    return _let(known, lambda t: F.when(t.isNotNull(), _let(sides(t), ratio)))


def tokens(name: Column) -> Column:
    """Sorted distinct tokens of a name, as :func:`same_performer` takes them."""
    return F.array_sort(_tokens(name))


def _tokens_near(ta: Column, tb: Column) -> Column:
    """``token_set_ratio`` of at least ``fx.TOKEN_SET_RATIO``, from sorted tokens."""
    share = 100 - fx.TOKEN_SET_RATIO
    close = lambda x, y, whole: (F.levenshtein(x, y) * 100 <= whole * share) & (
        (F.length(x) + F.length(y) - 2 * lcs(x, y)) * 100 <= whole * share
    )
    text = lambda t: F.array_join(t, " ")
    sides = F.struct(
        F.length(text(F.array_intersect(ta, tb))).alias("shared"), text(F.array_except(ta, tb)).alias("x"), text(F.array_except(tb, ta)).alias("y")
    )

    def overlapping(t: Column) -> Column:
        shared, rest_a, rest_b = t["shared"] + 1, F.length(t["x"]), F.length(t["y"])
        against = lambda rest: (1 + rest) * 100 <= (2 * shared - 1 + rest) * share
        return (rest_a == 0) | (rest_b == 0) | against(rest_a) | against(rest_b) | close(t["x"], t["y"], 2 * shared + rest_a + rest_b)

    apart = (F.size(ta) > 0) & (F.size(tb) > 0) & close(text(ta), text(tb), F.length(text(ta)) + F.length(text(tb)))
    return F.when(F.arrays_overlap(ta, tb), _let(sides, overlapping)).otherwise(apart)


def same_performer(a: Column, b: Column, tokens_a: Column | None = None, tokens_b: Column | None = None) -> Column:
    """Headliner test: ratio, window ratio or token-set ratio above its threshold; false if a side is NULL.

    Edits that replace a character count once in the Levenshtein distance and twice in the indel distance, so the
    first is never larger; being compiled code, it spares most pairs the subsequence. ``tokens_a`` and ``tokens_b`` are
    the names' :func:`tokens`, for callers that have them.
    """
    a, b = _columns(a, b)
    total, least = F.length(a) + F.length(b), F.least(F.length(a), F.length(b))
    # A window as good as 95 needs a common subsequence of at least 0.95/1.05 of the shorter name.
    scale = 100 + (100 - fx.PARTIAL_RATIO)
    may = F.levenshtein(a, b)
    gate = (may * 100 <= total * (100 - fx.NAME_RATIO)) | (may * scale <= total * scale - least * (2 * fx.PARTIAL_RATIO))
    near = lambda n: (n * 200 >= total * fx.NAME_RATIO) | ((n * scale >= least * fx.PARTIAL_RATIO) & (partial_ratio(a, b) >= fx.PARTIAL_RATIO))
    by_tokens = _tokens_near(tokens(a) if tokens_a is None else tokens_a, tokens(b) if tokens_b is None else tokens_b)
    return F.coalesce((a == b) | (gate & _let(lcs(a, b), near)) | by_tokens, F.lit(False))


def any_close(a: Column, b: Column) -> Column:
    """True when some name of one list is within the name ratio of one of the other; NULL lists give false."""
    a, b = _columns(a, b)
    close = lambda x, y: length_compatible(x, y, fx.NAME_RATIO) & ratio_at_least(x, y)
    return F.coalesce(F.exists(a, lambda x: F.exists(b, lambda y: close(x, y))), F.lit(False))


def _within(a: Column, b: Column, percent: int) -> Column:
    """Cheap necessary condition: the Levenshtein distance is never larger than the indel distance."""
    return F.levenshtein(a, b) * 100 <= (F.length(a) + F.length(b)) * (100 - percent)


def ratio_at_least(a: Column, b: Column, percent: int = fx.NAME_RATIO) -> Column:
    """Indel ratio of two strings, compared in whole numbers."""
    return (a == b) | (_within(a, b, percent) & (lcs(a, b) * 200 >= (F.length(a) + F.length(b)) * percent))


def ratio_above(a: Column, b: Column, percent: int) -> Column:
    return (a == b) | (_within(a, b, percent) & (lcs(a, b) * 200 > (F.length(a) + F.length(b)) * percent))


def length_compatible(a: Column, b: Column, percent: int) -> Column:
    """Cheap necessary condition for an indel ratio of at least ``percent``."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return short * 200 >= (short + long) * percent


# -- Arrow batches --------------------------------------------------------------------


def _same_performer(a: str, b: str) -> bool:
    la, lb, common = len(a), len(b), lcs_of(a, b)
    if 200 * common >= fx.NAME_RATIO * (la + lb):
        return True
    # A window as good as 95 needs an LCS of at least 0.95/1.05 of the shorter name.
    if 105 * common >= fx.PARTIAL_RATIO * min(la, lb) and partial_of(a, b) >= fx.PARTIAL_RATIO:
        return True
    return token_set_of(a, b) >= fx.TOKEN_SET_RATIO


@F.pandas_udf(T.BooleanType())
def same_performer_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`same_performer` for many pairs of few names: each distinct pair of a batch is tested once."""
    known: dict[tuple, bool] = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = pair[0] is not None and pair[1] is not None and (pair[0] == pair[1] or _same_performer(*pair))
        out.append(known[pair])
    return pd.Series(out, dtype="bool")


@F.pandas_udf(T.IntegerType())
def lcs_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`lcs`, once per distinct pair of a batch; 0 where a side is NULL."""
    known: dict[tuple, int] = {}
    for pair in set(zip(a, b)):
        known[pair] = 0 if pair[0] is None or pair[1] is None else lcs_of(*pair)
    return pd.Series([known[p] for p in zip(a, b)], dtype="int32")


@F.pandas_udf(T.BooleanType())
def any_close_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`any_close`, once per distinct pair of names of a batch."""
    known: dict[tuple[str, str], bool] = {}

    def close(x: str, y: str) -> bool:
        if (x, y) not in known:
            total = len(x) + len(y)
            fits = 200 * min(len(x), len(y)) >= fx.NAME_RATIO * total
            known[x, y] = x == y or fits and 200 * lcs_of(x, y) >= fx.NAME_RATIO * total
        return known[x, y]

    return pd.Series([xs is not None and ys is not None and any(close(x, y) for x in set(xs) for y in set(ys)) for xs, ys in zip(a, b)], dtype="bool")


def _sql_function(fn):
    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b)], dtype="float64")

    return ratio


def register(spark: SparkSession) -> None:
    """Expose the three ratios to SQL. SQL text cannot hold the columns above, so these run in Arrow batches."""
    for name, fn in (("indel_ratio", ratio_of), ("partial_ratio", partial_of), ("token_set_ratio", token_set_of)):
        spark.udf.register(name, _sql_function(fn))
