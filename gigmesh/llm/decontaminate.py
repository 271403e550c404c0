"""Benchmark decontamination: an FM-index per shard of the corpus, searched for test phrases.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased (A-Z) text. Every ten consecutive
words of an item are a phrase; a shorter item is one phrase; an item without words has none.
Shards of bounded size are indexed where their rows lie and stored as a table in the shared
checkpoint folder; phrases come in blocks of bounded size, each broadcast to one search over
the stored shards. Occurrences are located, and overlapping ones merge into spans of words.

Null and empty texts have no words. A text too long for a shard is cut into portions that
overlap by a phrase. Repeated rows are each reported. Items without an id are left out; items
that share an id count once. Empty tables give empty results or no hits. Only the named
columns are read, so further columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gigmesh.llm import textbytes as tb
from gigmesh.llm.fm_index import CAPACITY, Index
from gigmesh.runtime import cut_lineage

WIDTH = 10
#: Words of a text that one portion owns.
PORTION = 1 << 19
#: Phrases in one broadcast: 80 bytes each.
BLOCK = 1 << 18

_PARTS = ["n", "vocabulary", "counts", "bits", "ranks", "zeros", "marks", "mark_ranks", "positions"]
_OWNERS = ["portion", "doc_id", "text_key", "row", "first", "owned", "shift", "length"]
INDEX_SCHEMA = ", ".join(f"{c} binary" for c in _PARTS + _OWNERS)
HIT_SCHEMA = (
    "doc_id bigint, text_key bigint, row bigint, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"
)


class _Shard:
    """Texts gathered for one index; equal ones are indexed once."""

    def __init__(self) -> None:
        self.size, self.texts, self.known, self.owners = 0, [], {}, []

    def add(self, words: np.ndarray, owner: tuple) -> bool:
        """False if there is no room."""
        key = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
        if key not in self.known:
            if self.size + len(words) + 1 > CAPACITY:
                return False
            self.known[key] = len(self.texts)
            self.texts.append(words)
            self.size += len(words) + 1
        elif len(self.owners) >= CAPACITY:
            return False
        self.owners.append((self.known[key], *owner, len(words)))
        return True

    def row(self) -> pa.RecordBatch:
        parts = Index.build(self.texts).to_bytes() + [c.tobytes() for c in np.array(self.owners, np.int64).T]
        return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=_PARTS + _OWNERS)


def build_index(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A table of indexed shards over all texts of ``docs`` (``doc_id``, ``text``)."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, row = _Shard(), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").fill_null(-(1 << 63)))
            keys = np.asarray(batch.column("text_key"))
            for s in tb.slices(batch.column("text")):
                data = tb.LOWER[s.data]
                starts, ends, bounds = tb.find_words(data, s.offsets, tb.ALNUM)
                hashes = tb.word_hashes(data, starts, ends)
                for i in range(s.last - s.first):
                    own = hashes[bounds[i] : bounds[i + 1]]
                    for first in range(0, max(1, len(own)), PORTION):
                        owned = min(PORTION, len(own) - first)
                        lead = min(first, width - 1)
                        words = own[first - lead : first + owned + width - 1]
                        owner = (ids[s.first + i], keys[s.first + i], row, first, owned, lead)
                        if not shard.add(words, owner):
                            yield shard.row()
                            shard = _Shard()
                            shard.add(words, owner)
                    row += 1
        if shard.owners:
            yield shard.row()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return cut_lineage(tb.small_batches(texts).mapInArrow(tb.freeing(shards), INDEX_SCHEMA))


def _phrases(items: DataFrame, width: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (hashes, lengths, owner's phrase, owner's item); items stream through the driver one by one."""
    table: dict[bytes, int] = {}
    rows: list[np.ndarray] = []
    lengths: list[int] = []
    owners: set[tuple[int, str]] = set()

    def packed():
        mine = sorted(owners)
        return (
            np.array(rows, np.uint64), np.array(lengths, np.int64),
            np.array([p for p, _ in mine], np.int64), np.array([i for _, i in mine], dtype=object),
        )

    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    for r in named.toLocalIterator():
        raw = tb.LOWER[np.frombuffer(r["text"].encode(), np.uint8)]
        starts, ends, _ = tb.find_words(raw, np.array([0, len(raw)]), tb.ALNUM)
        words = tb.word_hashes(raw, starts, ends)
        size = min(width, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            phrase = np.zeros(width, np.uint64)
            phrase[:size] = words[k : k + size]
            key = phrase.tobytes()
            if key not in table:
                table[key] = len(rows)
                rows.append(phrase)
                lengths.append(size)
            owners.add((table[key], r["item_id"]))
            if len(owners) >= block:
                yield packed()
                table, rows, lengths, owners = {}, [], [], set()
    yield packed()


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def search(index: DataFrame, block, every: bool) -> DataFrame:
    """Hits of one block of phrases; ``every`` also returns texts without hits.

    Positions are words of the whole text. ``row`` tells repeated rows apart.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, lengths, owner_phrase, owner_item = block.value
        for batch in batches:
            for at in range(batch.num_rows):
                cell = {c: batch.column(c)[at].as_buffer() for c in _PARTS + _OWNERS}
                ix = Index.from_bytes([cell[c] for c in _PARTS])
                portion, doc, key, row, first, owned, shift, length = (np.frombuffer(cell[c], np.int64) for c in _OWNERS)
                lo, hi = ix.find(phrases, lengths)
                found = np.flatnonzero(hi > lo)
                times = (hi - lo)[found]
                begin = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
                places = ix.locate(begin + np.arange(times.sum()))
                which = np.repeat(found, times)
                change = np.zeros(ix.n + 1, np.int64)
                np.add.at(change, places, 1)
                np.add.at(change, places + lengths[which], -1)
                hit = np.cumsum(change[:-1]) > 0
                order = np.argsort(places, kind="stable")
                places, which = places[order], which[order]
                _, firsts = np.unique(portion, return_index=True)
                bounds = np.concatenate([[0], np.cumsum(length[firsts] + 1)])
                n_words, starts, ends, items = [], [], [], []
                for j in range(len(doc)):
                    a = bounds[portion[j]]
                    b = a + length[j]
                    core = hit[a + shift[j] : a + shift[j] + owned[j]]
                    n_words.append(int(owned[j]))
                    if not core.any():
                        starts.append([]), ends.append([]), items.append([])
                        continue
                    s, e = _runs(core)
                    starts.append((s + first[j]).tolist())
                    ends.append((e + first[j]).tolist())
                    p, q = np.searchsorted(places, [a, b])
                    inside = (places[p:q] < a + shift[j] + owned[j]) & (places[p:q] + lengths[which[p:q]] > a + shift[j])
                    used = np.unique(which[p:q][inside])
                    ids: set[str] = set()
                    for u, v in zip(np.searchsorted(owner_phrase, used), np.searchsorted(owner_phrase, used, side="right"), strict=True):
                        ids.update(owner_item[u:v])
                    items.append(sorted(ids))
                keep = np.array([every or bool(x) for x in starts], bool)
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc, mask=doc == -(1 << 63)), pa.array(key), pa.array(row), pa.array(n_words, pa.int64()),
                        pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=["doc_id", "text_key", "row", "n_words", "starts", "ends", "items"],
                )
                yield out.filter(pa.array(keep))

    return tb.small_batches(index).mapInArrow(tb.freeing(look), HIT_SCHEMA)


def _merged(pairs):
    """Union of word spans: sorted spans folded into disjoint ones."""
    span = "struct<s:bigint,e:bigint>"
    return F.aggregate(
        F.array_sort(pairs),
        F.array().cast(f"array<{span}>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["e"] >= x["s"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["s"].alias("s"), F.greatest(F.element_at(done, -1)["e"], x["e"]).alias("e"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, spans, n_hit, items`` (sorted as strings)."""
    index = build_index(docs, width)
    sc = docs.sparkSession.sparkContext
    found = None
    for phrases in _phrases(items, width, block):
        hits = search(index, sc.broadcast(phrases), found is None)
        found = hits if found is None else found.unionByName(hits.withColumn("n_words", F.lit(0).cast("bigint")))
    rows = found.groupBy("row", "doc_id", "text_key").agg(
        F.sum("n_words").alias("n_words"),
        F.flatten(F.collect_list(F.arrays_zip(F.col("starts").alias("s"), F.col("ends").alias("e")))).alias("pairs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    spans = rows.select("doc_id", "text_key", "n_words", "items", _merged(F.col("pairs")).alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["e"] - x["s"])
    return spans.withColumn("n_hit", n_hit)


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS phrase
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM p),
places AS (
  SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS phrase
  FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS r(k) WHERE len(w) >= size),
found AS (SELECT doc_id, k, size, item_id FROM places JOIN p USING (size, phrase)),
hits AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM found, unnest(range(k, k + size)) AS r(x) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
        FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the words of the spans, and what lies between them, removed from ``text``."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, found):
            if found is None or not len(found):
                return text
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = tb.find_words(tb.LOWER[raw], np.array([0, len(raw)]), tb.ALNUM)
            kept, at = [], 0
            for x in found:
                kept.append(raw[at : starts[x["s"]]].tobytes())
                at = ends[x["e"] - 1]
            return b"".join([*kept, raw[at:].tobytes()]).decode()

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    doc, key, cuts = tb.unused(docs.columns, "cut_id", "cut_key", "cut_spans")
    found = spans.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(F.first("spans").alias(cuts))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left")
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(cut("text", cuts))
    return joined.withColumn("text", text).select(*docs.columns)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every hit span out of its text; ``n_chars`` follows."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0")
    return cut_spans(docs, found).withColumn("n_chars", F.length("text").cast("bigint"))
