"""Similarity self-join of distinct strings.

The indel ratio of two strings reaches ``p`` only when they share enough characters, counted with
multiplicity: at least ``o`` of their ``(character, occurrence)`` marks. In any fixed order of marks, the first
``t`` shared ones then lie among the first ``n - o + t`` marks of either string. So strings publish
all ``t``-subsets of that many of their rarest marks, and a pair within the ratio has one in common.

Subsets of up to three rare marks are selective where single marks are not. Keys also carry a pair of length buckets:
``o``, and with it the number of marks, follows from the two lengths, and strings whose lengths
rule each other out never meet. A small bitmap of all marks bounds the overlap of those that meet, before any
ratio is computed. How frequent marks are is measured on the strings at hand: those of characters that make
up more than one in ``SHARE`` of all, so at most ``SHARE`` times ``OCCURRENCES`` numbers reach the driver.

Strings of few different characters, such as numbers, share keys with very many others. How often keys would meet is
counted first; where that is more work than one in ``WORTH`` of all pairs, :mod:`gigmesh.operators.all_pairs` compares these directly. Both are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gigmesh import fixed_values as fx
from gigmesh.functions import fuzzy
from gigmesh.operators.all_pairs import all_pairs
from gigmesh.runtime import computed_once, cut_lineage

SHARE = 64
#: Length buckets in which lengths double.
STEPS = 8
#: Marks beyond the needed overlap up to which three, or two, marks make a key.
TRIPLES, PAIRS = 4, 14
#: Occurrences of a frequent character that are counted one by one.
OCCURRENCES = 8
#: A meeting of keys costs about this many comparisons of a pair in a block; beginning with blocks costs ``BEGIN``.
WORTH, BEGIN = 16, 1 << 20
_LATER = 1 << 21
_PRIVATE = 0xE000
_BITS = 63


def frequent_characters(names: DataFrame) -> str:
    """Characters that make up more than one in ``SHARE`` of all in column ``s``."""
    counts = names.select(F.explode(F.split("s", "")).alias("c")).groupBy("c").count()
    total = names.agg(F.sum(F.length("s"))).first()[0] or 0
    return "".join(sorted(r["c"] for r in counts.where(F.col("count") * SHARE > total).collect()))


def _bucket(n: Column) -> Column:
    return F.floor(F.log2(n) * STEPS).cast("int")


def _least_length(bucket: Column) -> Column:
    return F.floor(F.pow(F.lit(2.0), bucket / STEPS)).cast("int")


def _needed(total: Column, percent: int) -> Column:
    return F.ceil(total * percent / F.lit(200.0) - F.lit(1e-9)).cast("int")


def marked(names: DataFrame) -> DataFrame:
    """``s, n, marks, low_bits, high_bits``: lengths, marks as numbers from rare to frequent, and their bitmap."""
    frequent = frequent_characters(names)
    moved = F.translate("s", frequent, "".join(chr(_PRIVATE + k) for k in range(len(frequent)))) if frequent else F.col("s")
    chars = computed_once(names.select("s", F.split(moved, "").alias("chars")), "chars")
    occurrence = lambda x, i: F.size(F.filter(F.slice("chars", F.lit(1), i + 1), lambda y: y == x))

    def mark(x: Column, i: Column) -> Column:
        place = F.ascii(x) - _PRIVATE
        counted = (place >= 0) & (place < len(frequent)) & (occurrence(x, i) <= OCCURRENCES)
        # All others are rare: negative, later occurrences first.
        return F.when(counted, place * OCCURRENCES + occurrence(x, i) - 1).otherwise(F.ascii(x) - occurrence(x, i).cast("bigint") * _LATER).cast("bigint")

    raw = computed_once(chars.select("s", F.transform("chars", mark).alias("raw")), "raw")
    counts = raw.select(F.explode("raw").alias("mark")).where("mark >= 0").groupBy("mark").count().collect()
    ranks = [0] * (len(frequent) * OCCURRENCES + 1)
    for rank, r in enumerate(sorted(counts, key=lambda r: (r["count"], r["mark"]))):
        ranks[r["mark"]] = rank
    ranked = F.transform("raw", lambda m: F.when(m < 0, m).otherwise(F.get(F.lit(ranks), m.cast("int")).cast("bigint")))
    whole = computed_once(raw.select("s", F.length("s").alias("n"), F.array_sort(ranked).alias("marks")), "marks")
    spot = lambda m: F.pmod(m, F.lit(2 * _BITS).cast("bigint"))
    bits = lambda word: F.aggregate(
        F.filter("marks", lambda m: F.floor(spot(m) / _BITS) == word), F.lit(0).cast("bigint"),
        lambda s, m: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(spot(m), F.lit(_BITS).cast("bigint")).cast("int"))),
    )
    return whole.select("*", bits(0).alias("low_bits"), bits(1).alias("high_bits"))


def posted(marked_names: DataFrame, percent: int, longer: bool) -> DataFrame:
    """``key, s, bucket, n`` and bitmap for the keys under which partners of larger (or smaller) length buckets are met."""
    n, own = F.col("n"), _bucket(F.col("n"))
    least, most = F.ceil(n * percent / F.lit(200.0 - percent) - F.lit(1e-9)), F.floor(n * F.lit(200.0 - percent) / percent + F.lit(1e-9))
    buckets = F.sequence(own, _bucket(most)) if longer else F.sequence(_bucket(F.greatest(least, F.lit(1))), own)
    each = marked_names.select("s", "n", "marks", "low_bits", "high_bits", own.alias("bucket"), least.cast("int").alias("least"), F.explode(buckets).alias("other"))
    low, high = F.least("bucket", "other"), F.greatest("bucket", "other")
    overlap = F.greatest(_needed(_least_length(low) + _least_length(high), percent), F.lit(1))
    spare = _least_length(high) - overlap
    size = F.least(F.when(spare <= TRIPLES, 3).when(spare <= PAIRS, 2).otherwise(1), overlap)
    take = F.greatest(n - _needed(n + F.greatest("least", _least_length(F.col("other"))), percent) + F.col("size"), F.lit(0))
    sized = each.select("s", "n", "marks", "low_bits", "high_bits", "bucket", low.alias("low"), high.alias("high"), "other", "least", size.alias("size"))
    cut = computed_once(sized.select("s", "n", "bucket", "low_bits", "high_bits", "low", "high", "size", F.slice("marks", F.lit(1), take).alias("some")), "some")
    named = lambda *marks: F.xxhash64("low", "high", *marks)
    behind = lambda i: F.slice("some", i + 2, F.size("some"))
    one = F.transform("some", lambda x: named(x))
    two = F.flatten(F.transform("some", lambda x, i: F.transform(behind(i), lambda y: named(x, y))))
    three = F.flatten(
        F.transform("some", lambda x, i: F.flatten(F.transform(behind(i), lambda y, j: F.transform(F.slice("some", i + j + 3, F.size("some")), lambda z: named(x, y, z)))))
    )
    keys = F.when(F.col("size") == 3, three).when(F.col("size") == 2, two).otherwise(one)
    return cut.select(F.explode(keys).alias("key"), "s", "bucket", "n", "low_bits", "high_bits")


def meetings(known: DataFrame, percent: int) -> int:
    """How often keys of :func:`marked` names meet: one number reaches the driver."""
    counts = lambda longer: posted(known, percent, longer).groupBy("key").count()
    x, y = counts(True).withColumnRenamed("count", "n"), counts(False).withColumnRenamed("count", "m")
    return x.join(y, "key").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0


def candidates(names: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a < b`` of column ``s`` that share a key and whose lengths allow the ratio."""
    return _met(cut_lineage(marked(names)), percent)


def _met(known: DataFrame, percent: int) -> DataFrame:
    x, y = posted(known, percent, True).alias("x"), posted(known, percent, False).alias("y")
    once = (F.col("x.bucket") < F.col("y.bucket")) | ((F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.s") < F.col("y.s")))
    lost = lambda a, b: sum(
        F.bit_count(F.col(f"{a}.{bits}").bitwiseAND(F.bitwise_not(F.col(f"{b}.{bits}")))) for bits in ("low_bits", "high_bits")
    )
    # Each bit of one that the other lacks is a mark that they don't share.
    fits = F.least(F.col("x.n") - lost("x", "y"), F.col("y.n") - lost("y", "x")) * 200 >= (F.col("x.n") + F.col("y.n")) * percent
    # Names look small to the planner, but each has many keys: without the hint they would pass through the driver.
    met = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & once & fits)
    return met.select(F.least("x.s", "y.s").alias("a"), F.greatest("x.s", "y.s").alias("b")).distinct()


def similar_pairs(df: DataFrame, column: str, percent: int = fx.NAME_RATIO, strict: bool = False) -> DataFrame:
    """Pairs ``(a, b)`` with ``a < b`` of distinct values whose ratio reaches ``percent``.

    ``strict`` asks for more than ``percent``. Empty strings pair with nothing.
    """
    names = cut_lineage(df.select(F.col(column).alias("s")).where(F.col("s") != "").distinct())
    test = fuzzy.ratio_above if strict else fuzzy.ratio_at_least
    known, count = cut_lineage(marked(names)), names.count()
    if meetings(known, percent) * WORTH > count * (count - 1) / 2 + BEGIN:
        return all_pairs(names, count, percent, strict)
    return _met(known, percent).where(test(F.col("a"), F.col("b"), percent))
