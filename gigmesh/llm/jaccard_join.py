"""N-gram Jaccard join with a token-group matrix: exact links, components per document.

A document's set holds its distinct runs of five words (`[^\\x20\\x09-\\x0D]+` of the lower-cased
text, A-Z only); fewer words are one run; no words, an empty set that links with nothing.
Two documents link when 100 times the shared runs reach 75 times the union.

1. One pass hashes every text: set size, signature of the whole set, a small min-hash sketch.
   Equal sets become one node. The same pass reports runs that are frequent within parts of it.
2. Documents are partitioned into groups of similar ones: nodes that share sketch values with
   the smallest such node are compared with it, and links found this way join into groups.
   Copies by the thousand cost one comparison each.
3. Exactness does not rest on the sketches. Two linked sets share one of the rarest quarter of
   their runs (plus one) in any fixed order; frequent runs come last in ours. Runs that more
   than one node publishes are kept; among them, only those that cross groups.
4. Groups are cut into blocks of about ``BLOCK`` members. The matrix says which block publishes
   which run. A node queries the blocks of other groups that share a run and fit its size; the
   union of all runs in the block bounds the overlap, and only blocks that could hold a partner
   are opened. In them, the parities of hashed runs (``MARKS`` bits) bound what two sets don't
   share from below, so texts meet only where a link is possible; meeting texts are compared.
5. Components are taken over all links.

Null and empty texts have size 0 and are their own component. Repeated rows are each returned.
A row without ``doc_id`` gets the component of its equals, null if it has none. Rows that share
a ``doc_id`` are told apart by their texts. Empty tables give empty results; only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gigmesh.llm import textbytes as tb
from gigmesh.llm.components import components
from gigmesh.runtime import checkpoint_dir, cut_lineage

WIDTH = 5
PERCENT = 75
#: Values of the min-hash sketch, and how many must agree before a leader is tried.
SKETCH, AGREE = 8, 3
#: Bits of a set's parities: each run flips one, so two sets differ in at most as many bits as in runs.
MARKS = 1024
#: Runs counted together before frequent ones are reported, and the least count that is.
COUNTED, FREQUENT = 1 << 20, 3
#: Most frequent runs that shape the order. Any order gives the same links.
HEAVY = 1 << 16
#: Members of a block of the matrix.
BLOCK = 32
#: Comparisons with one text that a task makes before another copy of the text is used.
PER_COPY = 500

_MULTIPLIERS = tb.mix(np.arange(101, 101 + SKETCH, dtype=np.uint64)) | np.uint64(1)


def _sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct runs of each text."""
    data = tb.LOWER[data]
    starts, ends, bounds = tb.find_words(data, offsets, tb.SPACED)
    hashes = tb.word_hashes(data, starts, ends)
    for i in range(len(offsets) - 1):
        own = hashes[bounds[i] : bounds[i + 1]]
        yield np.unique(tb.windows(own, min(WIDTH, len(own)))) if len(own) else own


def shingle_set(text: str | bytes | None) -> np.ndarray:
    raw = np.frombuffer(text.encode() if isinstance(text, str) else text or b"", np.uint8)
    return next(_sets(raw, np.array([0, len(raw)])))


def _signature(runs: np.ndarray) -> bytes:
    return hashlib.blake2b(runs.tobytes(), digest_size=16).digest()


def packed_texts(docs: DataFrame) -> DataFrame:
    """``rep, packed``: ids with their compressed texts, for the shuffles ahead."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shut = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for s in tb.slices(batch.column("text")):
                texts = [shut.compress(s.text(i)) for i in range(s.last - s.first)]
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(s.first, s.last - s.first), pa.array(texts, pa.binary())], names=["rep", "packed"])

    return tb.small_batches(docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text")).mapInArrow(tb.freeing(pack), "rep bigint, packed binary")


def packed_set(packed: bytes) -> np.ndarray:
    return shingle_set(zstandard.ZstdDecompressor().decompress(packed))


def _placed_by(df: DataFrame, key: str) -> DataFrame:
    """A checkpoint of the distinct rows that keeps their partitioning by ``key``: joins on it move the other side only.

    The adaptive planner forgets the partitioning of what it ran, so it is off for this one job.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).distinct().checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _long(raw: bytes) -> int:
    return int.from_bytes(raw, "little", signed=True)


def _parities(runs: np.ndarray) -> np.ndarray:
    """For each of ``MARKS`` bits, whether an odd number of runs falls on it; as 64-bit numbers."""
    bits = np.bincount((runs % np.uint64(MARKS)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


_FEATURES = (
    "doc_id bigint, text_key bigint, n bigint, sig bigint, sig2 bigint, sketch array<bigint>, marks array<bigint>, token bigint, times bigint"
)


def features(docs: DataFrame) -> DataFrame:
    """A row per document, and rows ``(token, times)`` of runs that are frequent in parts of the table."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _FEATURES.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2 + [pa.int64()] * 2
        seen, held, size = set(), [], 0

        def frequent() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
            often = times >= FREQUENT
            tokens, times = tokens[often].view(np.int64), times[often].astype(np.int64)
            none = [pa.nulls(len(tokens), k) for k in kinds[:7]]
            return pa.RecordBatch.from_arrays([*none, pa.array(tokens), pa.array(times)], names=names)

        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for s in tb.slices(batch.column("text")):
                rows = []
                for runs in _sets(s.data, s.offsets):
                    sig = _signature(runs)
                    sketch = (runs[:, None] * _MULTIPLIERS).min(axis=0).view(np.int64) if len(runs) else np.zeros(0, np.int64)
                    rows.append((len(runs), _long(sig[:8]), _long(sig[8:]), sketch, _parities(runs)))
                    if sig not in seen:
                        seen.add(sig)
                        held.append(runs)
                        size += len(runs)
                columns = zip(*rows, strict=True)
                known = [c.slice(s.first, s.last - s.first) for c in (ids, keys)]
                known += [pa.array(c, k) for c, k in zip(columns, kinds[2:7], strict=True)]
                yield pa.RecordBatch.from_arrays([*known, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names=names)
                if size >= COUNTED:
                    yield frequent()
                    seen, held, size = set(), [], 0
        yield frequent()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return tb.small_batches(texts).mapInArrow(tb.freeing(hashed), _FEATURES)


def heavy_runs(feats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent runs and their counts, sorted by run; ``HEAVY`` rows at most reach the driver."""
    counts = feats.where("token is not null").groupBy("token").agg(F.sum("times").alias("times"))
    top = counts.orderBy(F.desc("times"), "token").limit(HEAVY).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top["times"].to_numpy(np.int64)[order]


def published(docs: DataFrame, heavy) -> DataFrame:
    """``token, sig, n, room``: each text's rarest runs, enough that linked sets share one.

    The first run that linked sets share leaves room for the overlap in both: its ``room``, from
    the run's place in the text's order, is at least ``PERCENT`` times the other's size.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, times = heavy.value
        some = np.zeros(1 << 20, bool)
        some[(tokens & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            for s in tb.slices(batch.column("text")):
                out, sigs, sizes, full = [], [], [], []
                for runs in _sets(s.data, s.offsets):
                    n = len(runs)
                    if not n:
                        continue
                    first = n - -(-PERCENT * n // 100) + 1
                    sigs.append(_long(_signature(runs)[:8]))
                    sizes.append(first)
                    full.append(n)
                    maybe = np.flatnonzero(some[(runs & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    if len(maybe):
                        place = np.minimum(np.searchsorted(tokens, runs[maybe]), len(tokens) - 1)
                        count = np.zeros(n, np.int64)
                        count[maybe] = np.where(tokens[place] == runs[maybe], times[place], 0)
                        runs = runs[np.argsort(count, kind="stable")]
                    out.append(runs[:first])
                if out:
                    n = np.repeat(np.array(full, np.int64), sizes)
                    place = np.concatenate([np.arange(x) for x in sizes])
                    columns = [np.concatenate(out).view(np.int64), np.repeat(np.array(sigs, np.int64), sizes), n, (100 + PERCENT) * (n - place) - PERCENT * n]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "sig", "n", "room"])

    return tb.small_batches(docs.select("text")).mapInArrow(tb.freeing(prefixes), "token bigint, sig bigint, n bigint, room bigint")


def _shared(rows: DataFrame, by: str) -> DataFrame:
    """Rows whose ``token`` occurs with more than one value of ``by`` and, by its sizes, could link."""
    w = Window.partitionBy("token")
    known = rows.select("*", F.min(by).over(w).alias("__a"), F.max(by).over(w).alias("__b"), F.min("n").over(w).alias("__n"), F.max("room").over(w).alias("__room"))
    fits = (F.col("__a") != F.col("__b")) & (F.col("room") >= PERCENT * F.col("__n")) & (F.col("__room") >= PERCENT * F.col("n"))
    return known.where(fits).select(*rows.columns)


def _needed_overlap(a, b):
    """Least shared runs of linked sets of sizes ``a`` and ``b``."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _sizes_fit(a, b):
    return (PERCENT * F.col(a) <= 100 * F.col(b)) & (PERCENT * F.col(b) <= 100 * F.col(a))


def _may_link(x, marks_x, y, marks_y):
    """Whether sets of sizes ``x`` and ``y`` can link, given that they differ in at least as many runs as their marks in bits."""
    bits = F.zip_with(marks_x, marks_y, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    apart = F.aggregate(bits, F.lit(0), lambda total, k: total + k)
    return (100 + PERCENT) * (F.col(x) + F.col(y) - apart) >= 2 * PERCENT * (F.col(x) + F.col(y))


def leader_pairs(nodes: DataFrame) -> DataFrame:
    """``a, b``: each node with the smallest node that shares some sketch value, if several values agree."""
    keyed = nodes.select("rep", F.posexplode("sketch").alias("k", "value"))
    least = keyed.groupBy("k", "value").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader <> last")
    near = keyed.join(least, ["k", "value"]).where("rep <> leader").groupBy("rep", "leader").count()
    return near.where(F.col("count") >= AGREE).select(F.col("rep").alias("a"), F.col("leader").alias("b"))


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets link, by exact comparison of their texts (``rep, packed``).

    ``texts`` is partitioned by ``rep`` and stays where it is. One ``b`` may stand in very many
    pairs: its text is repeated, one copy for each ``PER_COPY`` pairs.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, np.ndarray] = {}
            keep = []
            for sides in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                if len(known) > 512:
                    known.clear()
                for packed in sides:
                    if packed not in known:
                        known[packed] = packed_set(packed)
                x, y = known[sides[0]], known[sides[1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(PER_COPY)).alias("copies"))
    right = copies.join(texts, F.col("b") == F.col("rep")).select(
        "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"), F.col("packed").alias("right")
    )
    dealt = pairs.join(copies, "b").select("a", "b", F.pmod(F.xxhash64("a"), "copies").alias("copy"))
    left = dealt.join(texts, F.col("a") == F.col("rep")).select("a", "b", "copy", F.col("packed").alias("left"))
    return tb.small_batches(left.join(right, ["b", "copy"]).select("a", "b", "left", "right")).mapInArrow(tb.freeing(compare), "a bigint, b bigint")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes with their block of the matrix: a slot inside their group."""
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1")
    slots = F.ceil(F.coalesce("members", F.lit(1)) / F.lit(BLOCK))
    placed = nodes.join(sizes, "grp", "left").withColumn("slot", F.pmod(F.xxhash64("rep"), slots).cast("bigint"))
    return placed.withColumn("alone", F.col("members").isNull()).drop("members")


def _bounded(queries: DataFrame, texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Queries ``(rep, grp, slot)`` whose overlap with the block's union may reach a partner."""

    def union(frame: pd.DataFrame) -> pd.DataFrame:
        joined = np.unique(np.concatenate([packed_set(x) for x in frame["packed"]])).tobytes()
        return pd.DataFrame({"grp": frame["grp"].iloc[:1], "slot": frame["slot"].iloc[:1], "runs": [joined], "least": [int(frame["n"].min())]})

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for packed, runs, least in zip(*(batch.column(c).to_pylist() for c in ("packed", "runs", "least")), strict=True):
                own = packed_set(packed)
                both = len(np.intersect1d(own, np.frombuffer(runs, np.uint64), assume_unique=True))
                smallest = max(least, -(-PERCENT * len(own) // 100))
                keep.append(both >= _needed_overlap(len(own), smallest))
            yield batch.select(["rep", "n", "grp", "slot"]).filter(pa.array(keep, pa.bool_()))

    wanted = queries.select("grp", "slot").distinct()
    members = blocks.join(wanted, ["grp", "slot"]).join(texts, "rep").select("grp", "slot", "n", "packed")
    unions = members.groupBy("grp", "slot").applyInPandas(union, "grp bigint, slot bigint, runs binary, least bigint")
    asked = queries.join(unions, ["grp", "slot"]).join(texts, "rep").select("rep", queries["n"], "grp", "slot", "packed", "runs", "least")
    return tb.small_batches(asked).mapInArrow(tb.freeing(reach), "rep bigint, n bigint, grp bigint, slot bigint")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id`` per row; ``text_key`` is the text's xxhash64."""
    sc = docs.sparkSession.sparkContext
    feats = cut_lineage(features(docs))
    rows = feats.where("sig is not null").select("doc_id", "text_key", "n", "sig", "sig2", "sketch", "marks")
    same = [F.first(c).alias(c) for c in ("n", "sketch", "marks")]
    nodes = cut_lineage(rows.groupBy("sig", "sig2").agg(F.min("doc_id").alias("rep"), *same))
    full = nodes.where("n > 0 and rep is not null")

    # Published runs that several nodes share, and the texts of those nodes.
    live = cut_lineage(_shared(published(docs, sc.broadcast(heavy_runs(feats))), "sig").distinct())
    needed = full.join(live.select("sig").distinct(), "sig", "left_semi").select("rep").distinct()
    texts = _placed_by(packed_texts(docs).join(needed.hint("merge"), "rep", "left_semi"), "rep")

    # Groups of similar nodes.
    near = cut_lineage(linked(cut_lineage(leader_pairs(full)), texts))
    groups = components(near.toDF("u", "v"))
    grouped = full.select("sig", "rep", "n").join(groups, F.col("rep") == F.col("node"), "left")
    placed = cut_lineage(_blocks(grouped.select("sig", "rep", "n", F.coalesce("component", "rep").alias("grp"))))

    # Queries across groups, through the matrix.
    crossing = cut_lineage(_shared(live.join(placed.drop("n"), "sig"), "grp"))
    matrix = crossing.groupBy("token", "grp", "slot", "alone").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("spare")
    )
    asked = crossing.select("token", "rep", "n", "room", F.col("grp").alias("own"))
    fits = (
        (F.col("own") < F.col("grp"))
        & (F.col("spare") >= PERCENT * F.col("n"))
        & (F.col("room") >= PERCENT * F.col("least")) & (100 * F.col("room") >= PERCENT * PERCENT * F.col("n"))
        & (PERCENT * F.col("n") <= 100 * F.col("most")) & (PERCENT * F.col("least") <= 100 * F.col("n"))
    )
    queries = cut_lineage(asked.join(matrix, "token").where(fits).select("rep", "n", "grp", "slot", "alone").distinct())
    # The union of a block of one is that member: opening it is the bound.
    opened = cut_lineage(
        queries.where("alone").select("rep", "n", "grp", "slot").union(_bounded(queries.where("not alone"), texts, placed))
    )
    marks = full.select("rep", "marks")
    members = placed.join(opened.select("grp", "slot").distinct(), ["grp", "slot"], "left_semi").join(marks, "rep")
    members = members.select(F.col("rep").alias("b"), F.col("n").alias("y"), F.col("marks").alias("marks_b"), "grp", "slot")
    asking = opened.join(marks, "rep").select(F.col("rep").alias("a"), F.col("n").alias("x"), F.col("marks").alias("marks_a"), "grp", "slot")
    possible = asking.join(members, ["grp", "slot"]).where(_sizes_fit("x", "y") & _may_link("x", "marks_a", "y", "marks_b"))
    across = linked(cut_lineage(possible.select("a", "b").distinct()), texts)

    links = components(near.union(across).toDF("u", "v"))
    ids = nodes.select("sig", "sig2", "rep").join(links, F.col("rep") == F.col("node"), "left")
    ids = ids.select("sig", "sig2", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "text_key", "n", "sig", "sig2").join(ids, ["sig", "sig2"])
    # Empty sets share a signature but link with nothing.
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id; rows that repeat id and text are one document."""
    first = jaccard_components(docs).where("doc_id <=> component_id").select("doc_id", "text_key").distinct()
    doc, key = tb.unused(docs.columns, "kept_id", "kept_key")
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key))
    return docs.join(first.toDF(doc, key).hint("merge"), same, "left_semi")


#: Pairs of the check share an exact run; small tables only, as SQL joins all runs.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS t FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(k)
  WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM pairs JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.v) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON d.doc_id = reach.u GROUP BY d.doc_id, n.n
"""
