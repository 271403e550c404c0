"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its
character n-grams, from the longest down: the first length of which some n-gram is known
scores the word by the mean of these n-grams. A text's score is the posterior of the best
language under the mean word score and the languages' shares.

The model is fitted on a bounded sample of labelled rows: per language, texts in the order of
a hash of their id up to ``SAMPLE_CHARS`` characters (fewer beyond ``FULL_SAMPLES`` languages), each
taken whole (a longer first one is taken too). Words seen once say nothing and are left to the n-grams. Ids and sources are no
input of a prediction.

Null texts and texts without a letter are `und` with score 0; so is every text when nothing
was learned. Texts of unknown letters only get the most frequent language. Ties go to the
smaller name. Repeated rows are each returned; empty tables give empty results. Only the
named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from gigmesh.llm import textbytes as tb

#: Characters of labelled text per language that the model is fitted on.
SAMPLE_CHARS = 1_500_000
#: Languages up to which each gets the whole sample. Every label that occurs is learned.
FULL_SAMPLES = 64
LONGEST_GRAM = 4
LEAST_COUNT = 2
#: Pieces of evidence in a text beyond which the posterior gets no sharper.
SHARPNESS = 20
REMEMBERED = 200_000
UNKNOWN = "und"

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


class Model:
    """Log frequencies of words and n-grams per language, less their mean over the languages."""

    def __init__(self, texts: Iterable[tuple[str, str]], shares: dict[str, float]) -> None:
        self.languages = sorted(shares)
        self.prior = np.log([shares[x] for x in self.languages]) if shares else np.zeros(0)
        counts = [[Counter() for _ in self.languages] for _ in range(LONGEST_GRAM + 1)]
        place = {lang: i for i, lang in enumerate(self.languages)}
        for lang, text in texts:
            i = place[lang]
            for word, times in Counter(words(text)).items():
                counts[0][i][word] += times
                for n in range(1, LONGEST_GRAM + 1):
                    for gram in grams(word, n):
                        counts[n][i][gram] += times
        built = [self._logs(c) for c in counts]
        self.keys = [{key: k for k, key in enumerate(keys)} for keys, _ in built]
        self.logs = [logs for _, logs in built]

    def _logs(self, counts: list[Counter]) -> tuple[list[str], np.ndarray]:
        total = Counter()
        for c in counts:
            total.update(c)
        keys = [key for key, n in total.items() if n >= LEAST_COUNT]
        rows = {key: k for k, key in enumerate(keys)}
        each = np.zeros((len(keys), len(counts)))
        for i, c in enumerate(counts):
            own = [(rows[key], n) for key, n in c.items() if key in rows]
            if own:
                at, times = zip(*own, strict=True)
                each[list(at), i] = times
        logs = np.log((each + 0.5) / (each.sum(axis=0) + 0.5 * max(1, len(keys))))
        return keys, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32) if keys else logs

    def word_scores(self, found: list[str]) -> np.ndarray:
        """A row per word: its score in each language, and 1; zeros if no part of it is known."""
        out = np.zeros((len(found), len(self.languages) + 1), np.float32)
        left = []
        for k, word in enumerate(found):
            row = self.keys[0].get(word)
            if row is None:
                left.append(k)
            else:
                out[k, :-1] = self.logs[0][row]
                out[k, -1] = 1
        for n in range(LONGEST_GRAM, 0, -1):
            known, rows, hit, counts, missed = self.keys[n], [], [], [], []
            for k in left:
                own = [known[g] for g in grams(found[k], n) if g in known]
                if own:
                    rows += own
                    hit.append(k)
                    counts.append(len(own))
                else:
                    missed.append(k)
            if hit:
                firsts = np.cumsum(counts) - counts
                out[hit, :-1] = np.add.reduceat(self.logs[n][rows], firsts, axis=0) / np.array(counts, np.float32)[:, None]
                out[hit, -1] = 1
            left = missed
        return out

    def predict(self, texts: list[str], memory: Memory) -> tuple[list[str], list[float]]:
        """Languages and scores of texts."""
        found = [words(t) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = memory.rows({w for own in found for w in own}, self)
        places = memory.places
        flat = np.array([places[w] for own in found for w in own], np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(own) for own in found])])
        sums = np.zeros((len(flat) + 1, rows.shape[1]))
        np.cumsum(rows[flat], axis=0, out=sums[1:])
        totals = sums[bounds[1:]] - sums[bounds[:-1]]
        evidence = np.rint(totals[:, -1:])
        logs = self.prior + totals[:, :-1] / np.maximum(evidence, 1) * np.minimum(evidence, SHARPNESS)
        chance = np.exp(logs - logs.max(axis=1, keepdims=True))
        best = chance.argmax(axis=1)
        score = chance[np.arange(len(texts)), best] / chance.sum(axis=1)
        names = [self.languages[b] if own else UNKNOWN for own, b in zip(found, best, strict=True)]
        return names, [float(x) if own else 0.0 for own, x in zip(found, score, strict=True)]


class Memory:
    """Scores of words that a task has met; starts over when full."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.table: np.ndarray | None = None

    def rows(self, found: set[str], model: Model) -> np.ndarray:
        if len(self.places) > REMEMBERED:
            self.places, self.table = {}, None
        fresh = [w for w in found if w not in self.places]
        known = len(self.places)
        scores = model.word_scores(fresh)
        if self.table is None:
            self.table = np.zeros((0, scores.shape[1]), np.float32)
        if known + len(fresh) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), known + len(fresh)), scores.shape[1]), np.float32)
            grown[:known] = self.table[:known]
            self.table = grown
        self.table[known : known + len(fresh)] = scores
        self.places.update(zip(fresh, range(known, known + len(fresh)), strict=True))
        return self.table


def fit(labelled: DataFrame) -> Model:
    """Fit on ``lang, text`` and a ``doc_id`` to sample by. Shares count all rows; the sample is bounded."""
    counted = labelled.groupBy("lang").agg(
        F.count("*").alias("count"), F.sum(F.length("text")).alias("chars"), F.min(F.xxhash64("doc_id")).alias("least")
    )
    shares = counted.orderBy("lang").collect()  # one row per label
    if not shares:
        return Model([], {})
    total = sum(r["count"] for r in shares)
    return Model(((r["lang"], r["text"]) for r in sample(labelled, shares).toLocalIterator()), {r["lang"]: r["count"] / total for r in shares})


def sample(labelled: DataFrame, shares: list[Row]) -> DataFrame:
    """``lang, text`` of the sample; ``shares`` has the characters and the least hash of each language."""
    chars = sample_chars(len(shares))
    # Per language, the hash below which about twice the sample's characters lie, and one text at least:
    # what is beyond never moves.
    top = (1 << 63) - 1
    most = [(r["lang"], max(r["least"], min(top, int(2.0 * chars / max(1, r["chars"]) * (1 << 64)) - top))) for r in shares]
    limits = F.broadcast(labelled.sparkSession.createDataFrame(most, "lang string, most bigint"))
    hashed = labelled.select("lang", "doc_id", "text", F.xxhash64("doc_id").alias("h"), F.length("text").alias("size"))
    thin = hashed.join(limits, "lang").where("h <= most")
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    return thin.select("lang", "text", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before")).where(F.col("before") < chars).drop("before")


def sample_chars(languages: int) -> int:
    """Characters per language: beyond ``FULL_SAMPLES`` languages fewer, by the square, as a model has keys times languages."""
    return max(1, int(SAMPLE_CHARS * min(1.0, FULL_SAMPLES / languages) ** 2))


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "text") + ", lang_pred string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, memory = shared.value, Memory()
        for batch in batches:
            for s in tb.slices(batch.column("text")):
                names, scores = fitted.predict([s.text(i).decode() for i in range(s.last - s.first)], memory)
                part = batch.slice(s.first, s.last - s.first)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"]
                )

    return tb.small_batches(kept).mapInArrow(score, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit(docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    marked = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return predict(marked, model, "doc_id", "held_out")
