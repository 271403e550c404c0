"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained on labelled texts, one of each class. A text is cut into blocks of
``BLOCK`` bytes, so that a long one doesn't outgrow the dictionaries; every block is compressed
with both. What the bad dictionary costs beyond the good one, per byte of text, is the measure, and
a logistic curve fitted on further labelled texts turns it into the probability of label 1.

Dictionaries and curve are fitted on a bounded sample of the labelled rows: per class, texts in
the order of a hash of their id, ``SAMPLE_ROWS`` of them at most. The first half feeds the
dictionary with ``PIECES`` pieces a text, spread over it, the rest the curve, weighted by how
frequent the classes are among all labelled rows. Scoring reads whole texts.

Null and empty texts get the curve's value at 0. Without labels of both classes the score of
every text is the share of label 1, or 0.5 if there is no label. Repeated rows are each
returned; of repeated labels of a document the largest counts. Empty tables give empty results.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gigmesh.llm import textbytes as tb

BLOCK = 512
LEVEL = 3
#: Labelled texts per class in the sample.
SAMPLE_ROWS = 1200
#: Size of a trained dictionary; pieces that one text adds to its training, and their bytes.
DICTIONARY_BYTES, PIECES, PIECE = 1 << 15, 6, 1 << 10
#: Score from which the label is predicted as 1.
ACCEPT = 0.7


@dataclass
class Classifier:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def scorer(self):
        """A function from a text's bytes to its measure; holds the compressors."""
        packs = []
        for content in (self.good, self.bad):
            shared = zstandard.ZstdCompressionDict(content)
            shared.precompute_compress(level=LEVEL)
            packs.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False)
            )

        def measure(text: bytes) -> float:
            sizes = [0, 0]
            for at in range(0, len(text), BLOCK):
                block = text[at : at + BLOCK]
                for k, pack in enumerate(packs):
                    sizes[k] += len(pack.compress(block))
            return (sizes[1] - sizes[0]) / len(text) if text else 0.0

        return measure

    def probability(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * measures + self.intercept, -30, 30)))


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on pieces of the texts; the pieces themselves if they are too few to train on."""
    pieces = []
    for text in texts:
        step = max(PIECE, len(text) // PIECES)
        pieces += [text[at : at + PIECE] for at in range(0, len(text), step)][:PIECES]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[:DICTIONARY_BYTES].ljust(8)


def _curve(measures: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve by Newton steps, lightly regularised."""
    center, scale = measures.mean(), measures.std() or 1.0
    x = np.column_stack([(measures - center) / scale, np.ones(len(measures))])
    w = np.zeros(2)
    ridge = np.array([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weights * (labels - p)) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1] - w[0] * center / scale)


def fit(sample: DataFrame, shares: dict[int, int]) -> Classifier:
    """Fit on ``doc_id, text, quality`` of a bounded sample; ``shares`` counts all labelled rows per class."""
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    chosen = sample.where("quality in (0, 1) and text is not null").withColumn("no", F.row_number().over(order)).where(F.col("no") <= SAMPLE_ROWS)
    texts: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
    for r in chosen.select("quality", "no", "text").toLocalIterator():
        texts[r["quality"]].append((r["no"], r["text"].encode()))
    if not texts[0] or not texts[1]:
        share = shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5
        return Classifier(b" " * 8, b" " * 8, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    own = [[t for _, t in sorted(texts[k])] for k in (0, 1)]
    # A class of one text has no second half: it serves both.
    half = [max(1, len(x) // 2) for x in own]
    held = [x[h:] or x for x, h in zip(own, half, strict=True)]
    model = Classifier(_dictionary(own[1][: half[1]]), _dictionary(own[0][: half[0]]), 0.0, 0.0)
    measure = model.scorer()
    measures = np.array([measure(t) for x in held for t in x])
    count = [len(x) for x in held]
    weights = np.repeat([shares[k] / sum(shares.values()) * sum(count) / count[k] for k in (0, 1)], count)
    model.slope, model.intercept = _curve(measures, np.repeat([0.0, 1.0], count), weights)
    return model


def score(docs: DataFrame, model: Classifier, *keep: str) -> DataFrame:
    """``keep`` columns and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "text") + ", score double"

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        measure = fitted.scorer()
        for batch in batches:
            for s in tb.slices(batch.column("text")):
                measures = np.array([measure(s.text(i)) for i in range(s.last - s.first)])
                part = batch.slice(s.first, s.last - s.first)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fitted.probability(measures))], names=[*keep, "score"])

    return tb.small_batches(kept).mapInArrow(rate, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labels = labels.where("quality in (0, 1)")
    shares = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    # About twice the sample of each class by a hash of the id, chosen where the labels lie and before any text moves.
    part = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30))
    limits = [F.when(F.col("quality") == k, F.lit(round(min(1.0, 2 * SAMPLE_ROWS / n) * (1 << 30)))) for k, n in shares.items()]
    chosen = labels.where(part < F.coalesce(*limits, F.lit(0))).limit(6 * SAMPLE_ROWS)
    # At most 6 * SAMPLE_ROWS ids: a proven bound.
    model = fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), shares)
    marked = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    scored = score(marked, model, "doc_id", "held_out")
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
