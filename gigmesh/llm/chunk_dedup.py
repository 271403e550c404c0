"""Substring dedup by content-defined chunks: a gear rolling hash cuts, digests find repeats.

A position is a cut when the high bits of the gear hash of the bytes before it are zero, unless
another candidate stands less than ``LEAST`` bytes before it; a chunk longer than ``MOST`` is
cut further at multiples of ``MOST``. Both rules look at nearby bytes only, so after an
insertion the cuts fall into step again within a chunk or two. Cuts move forward to the next
start of a UTF-8 character.

Chunks with one digest are copies; the first by (document, position) stays. Copies that follow
each other in a text form a run, and a run of at least ``RUN`` bytes is removed: single chunks
that agree by chance are left alone, a shared passage of fifty words is not.

Null and empty texts have no chunks. Rows that repeat both id and text are one document and are
treated alike; the texts of one ``doc_id`` each keep what no smaller id holds. Rows without
``doc_id`` come last in the order, as one document per text. Empty tables give empty results.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gigmesh.llm import textbytes as tb

#: Bits of the hash that must be zero: 32 bytes between candidates on average.
CUT_BITS = 5
LEAST, MOST = 8, 256
#: Bytes of copied chunks in a row that are removed.
RUN = 64
#: Stands for a missing ``doc_id``, after all others.
NO_ID = (1 << 63) - 1

#: The gear table: 16-bit values drawn from a rule. Shifting by one per byte, 16 bytes take part.
_GEAR = (tb.mix(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
CHUNK_SCHEMA = "doc_id bigint, text_key bigint, at bigint, size int, d1 bigint, d2 bigint"


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash after each byte: h = (h << 1) + G[byte], 16 bits wide; every step doubles the bytes taken in."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        older = h[:-k] << np.uint16(k)
        h = h.copy()
        h[k:] += older
    return h


def cuts(text: np.ndarray) -> np.ndarray:
    """Chunk bounds of one text, both ends included."""
    n = len(text)
    if n == 0:
        return np.zeros(1, np.int64)
    # The high bits depend on all 16 bytes, the low ones on fewer.
    found = np.flatnonzero(gear(text) >> np.uint16(16 - CUT_BITS) == 0) + 1
    apart = np.ones(len(found), bool)
    apart[1:] = np.diff(found) >= LEAST
    found = found[apart & (found < n)]
    bounds = np.concatenate([[0], found, [n]])
    gaps = np.diff(bounds)
    if (gaps > MOST).any():
        times = (gaps - 1) // MOST
        inner = np.repeat(bounds[:-1], times) + MOST * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1)
        bounds = np.sort(np.concatenate([bounds, inner]))
    starts = np.append((text & 0xC0) != 0x80, True)
    for _ in range(3):
        bounds = np.where(starts[bounds], bounds, bounds + 1)
    return np.unique(bounds)


def chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: its text, place, size in bytes and 128-bit digest."""
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for s in tb.slices(batch.column("text")):
                at, size, digests, count = [], [], [], []
                for i in range(s.last - s.first):
                    text = s.data[s.offsets[i] : s.offsets[i + 1]]
                    bounds = cuts(text)
                    raw = text.tobytes()
                    marks = bounds.tolist()
                    digests += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(marks, marks[1:], strict=False)]
                    at.append(bounds[:-1])
                    size.append(np.diff(bounds))
                    count.append(len(bounds) - 1)
                pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                which = pa.array(np.repeat(np.arange(s.first, s.last), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(which), keys.take(which), pa.array(np.concatenate(at)), pa.array(np.concatenate(size).astype(np.int32)),
                        pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])),
                    ],
                    names=names,
                )

    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return tb.small_batches(texts).mapInArrow(tb.freeing(cut), CHUNK_SCHEMA)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Chunks that repeat an earlier one, with the document that holds the first.

    The chunk table is derived twice rather than stored: it is as large as the texts.
    """
    every = chunks(docs)
    # Counts and minima combine before the shuffle; a digest in every document is one row per task.
    twice = every.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("times")).where("times > 1")
    copies = every.join(twice.drop("times").hint("merge"), ["d1", "d2"])
    inside = Window.partitionBy("doc_id", "text_key", "d1", "d2").orderBy("at")
    numbered = copies.withColumn("before", F.dense_rank().over(inside) - 1)
    again = numbered.where((F.col("doc_id") != F.col("first_doc_id")) | (F.col("before") > 0))
    return again.select("doc_id", "text_key", "at", "size", "first_doc_id")


def repeated_spans(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``doc_id, text_key, begin, finish, first_doc_id``: byte spans to remove.

    ``first_doc_id`` holds the first copy of the span's first chunk.
    """
    text = Window.partitionBy("doc_id", "text_key").orderBy("at")
    ahead = F.lag(F.col("at") + F.col("size")).over(text)
    # Repeated rows report the same chunk again, at the same place.
    joins = (ahead == F.col("at")) | (F.lag("at").over(text) == F.col("at"))
    marked = repeated_chunks(docs).withColumn("new", F.when(joins, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(text))
    spans = runs.groupBy("doc_id", "text_key", "run").agg(
        F.min("at").alias("begin"), F.max(F.col("at") + F.col("size")).alias("finish"), F.min_by("first_doc_id", "at").alias("first_doc_id")
    )
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    long = spans.where(F.col("finish") - F.col("begin") >= run)
    return long.select(known("doc_id"), "text_key", "begin", "finish", known("first_doc_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """Documents that repeat passages: removed spans in bytes, and who holds the first copies."""
    spans = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return spans.groupBy("doc_id", "text_key").agg(
        F.sum(F.col("finish") - F.col("begin")).alias("removed_bytes"),
        F.array_sort(F.collect_list(F.struct("begin", "finish"))).alias("spans"),
        F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"),
    ).drop("text_key")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the spans; rows that repeat both id and text are treated alike."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, found):
            if found is None or not len(found):
                return text
            raw, kept, at = text.encode(), [], 0
            for x in found:
                kept.append(raw[at : x["begin"]])
                at = x["finish"]
            return b"".join([*kept, raw[at:]]).decode()

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    doc, key, cuts = tb.unused(docs.columns, "cut_id", "cut_key", "cut_spans")
    found = spans.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(
        F.array_sort(F.collect_list(F.struct("begin", "finish"))).alias(cuts)
    )
    joined = docs.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left")
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(cut("text", cuts))
    return joined.withColumn("text", text).select(*docs.columns)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages; documents left without a word go."""
    cut = remove_spans(docs, repeated_spans(docs)).withColumn("n_chars", F.length("text").cast("bigint"))
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
