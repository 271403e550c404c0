"""Quality rules: hashed n-gram likelihood ratio of a trusted target against the raw corpus.

Words are runs of bytes other than space and ``\\t\\n\\v\\f\\r``. Their 1- and 2-grams fall into
``BUCKETS`` buckets. Two multinomials are counted: of trusted documents and of all. A bucket's
weight is the logarithm of their smoothed ratio in whole millionths, so sums don't depend on the
order of rows. A document passes when the mean weight of its n-grams reaches the threshold, and
its base figures pass. The target is fitted on a bounded
sample of the trusted documents (``TRUSTED``), the raw corpus is counted whole.

Null and empty texts have no words and fail the base rules. Repeated rows are judged alike,
each as a row. Empty tables give empty results. Only ``doc_id`` and ``text`` are read;
further columns, whatever their names, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gigmesh.llm import textbytes as tb

BUCKETS = 1 << 14
#: Counts of the raw distribution added to both sides; shrinks what few counts say towards 0.
SMOOTHING = 15.0
SCALE = 1_000_000
#: Mean weight that passes. Just under 0, as likely in the target as in the raw corpus: a clean
#: text outside the target scores about 0, and what few counts say about it varies by some hundredths.
THRESHOLD = -0.06
#: Trusted documents that the target is fitted on, give or take chance; the broadcast holds twice as many ids at most.
TRUSTED = 50_000
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_STARTS_POINT = tb.byte_set(True, (0x80, 0xBF))

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr_micros", "n_grams"]


def _grams(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the 1- and 2-grams of one text."""
    both = np.concatenate([hashes, tb.windows(hashes, 2)])
    return (both & np.uint64(BUCKETS - 1)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """``bucket, raw, target`` over all rows; ``docs`` has ``text`` and boolean ``trusted``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            trusted = np.asarray(batch.column("trusted").to_pylist(), bool)
            for s in tb.slices(batch.column("text")):
                starts, ends, bounds = tb.find_words(s.data, s.offsets, tb.SPACED)
                hashes = tb.word_hashes(s.data, starts, ends)
                for i in range(s.last - s.first):
                    grams = np.bincount(_grams(hashes[bounds[i] : bounds[i + 1]]), minlength=BUCKETS)
                    raw += grams
                    if trusted[s.first + i]:
                        target += grams
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"]
        )

    parts = tb.small_batches(docs.select("text", "trusted")).mapInArrow(tb.freeing(count), "bucket bigint, raw bigint, target bigint")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def gram_weights(counts: DataFrame) -> np.ndarray:
    """Whole-number weights. ``BUCKETS`` rows at most reach the driver, whatever the corpus."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.where(F.col("raw") > 0).toLocalIterator():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    expected = raw * (target.sum() / raw.sum())
    return np.rint(np.log((target + SMOOTHING) / (expected + SMOOTHING)) * SCALE).astype(np.int64)


def _repeated_words(triples: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(triples) < 2:
        return 0
    ordered = np.sort(triples)
    twice = ordered[1:] == ordered[:-1]
    if not twice.any():
        return 0
    again = np.isin(triples, np.unique(ordered[1:][twice]))
    hit = np.zeros(len(triples) + 2, bool)
    for k in range(3):
        hit[k : k + len(triples)] |= again
    return int(hit.sum())


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\v\f\r")]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Every row of ``docs`` as ``doc``, with its base figures and summed weights."""

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc")
            for s in tb.slices(docs.field("text")):
                starts, ends, bounds = tb.find_words(s.data, s.offsets, tb.SPACED)
                hashes = tb.word_hashes(s.data, starts, ends)
                points = np.concatenate([[0], np.cumsum(tb.SPACED[s.data] & _STARTS_POINT[s.data])])[s.offsets]
                symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[s.data])])[s.offsets]
                repeats, lines, sums, grams = [], [], [], []
                for i in range(s.last - s.first):
                    own = hashes[bounds[i] : bounds[i + 1]]
                    repeats.append(_repeated_words(tb.windows(own, 3)))
                    lines.append(_repeated_lines(s.text(i)))
                    buckets = _grams(own)
                    sums.append(int(weights[buckets].sum()))
                    grams.append(len(buckets))
                columns = [np.diff(bounds), np.diff(points), np.diff(symbols), lines, repeats, sums, grams]
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(s.first, s.last - s.first), *[pa.array(np.asarray(c, np.int64)) for c in columns]], names=["doc", *FIGURES]
                )

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in FIGURES)
    return tb.small_batches(rows).mapInArrow(tb.freeing(figures), schema)


def judge(measured: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``base_failed``, ``kept`` and ``llr``; all comparisons are of whole numbers."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    passes = F.col("llr_micros") >= F.lit(round(threshold * SCALE)) * F.col("n_grams")
    llr = F.col("llr_micros") / F.greatest("n_grams", F.lit(1)) / SCALE
    return measured.select("doc", *FIGURES[:5], failed.alias("base_failed"), (~failed & passes).alias("kept"), llr.alias("llr"))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` as ``doc``, judged; ``trusted`` holds the ``doc_id`` of the target's documents.

    The target is counted over ``TRUSTED`` of these, drawn by a hash of the id; the raw corpus over
    all rows. So no text moves: both passes read it where it lies.
    """
    good = trusted.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("__good")).distinct()
    share = min(1.0, TRUSTED / max(1, good.count()))
    drawn = good.where(F.pmod(F.xxhash64("__good"), F.lit(1 << 30)) < F.lit(round(share * (1 << 30)))).limit(2 * TRUSTED)
    marked = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("__good"), "left")
    counts = gram_counts(marked.select("text", F.col("__good").isNotNull().alias("trusted")))
    return judge(measure(docs, gram_weights(counts)), threshold)


def labelled_good(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = quality_rules(docs, labelled_good(spark, sf_dir))
    return judged.select(F.col("doc.doc_id").alias("doc_id"), *judged.columns[1:])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that pass; nothing is shuffled."""
    return quality_rules(docs, labelled_good(spark, sf_dir)).where("kept").select("doc.*")
