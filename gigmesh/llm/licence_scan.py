"""Licence scan: Dice coefficient over word bigrams between normalised text and templates.

Normalising lower-cases A-Z and keeps words of letters, digits and non-ASCII characters. Three
kinds of segments are compared with every template: each line, each paragraph (lines up to an
empty one) of several lines, and the whole text of several paragraphs. A bigram set of size b
reaches ``LEAST`` with one of size t only if LEAST / (2 - LEAST) * t <= b <= (2 - LEAST) / LEAST * t;
templates outside these bounds are never compared, and neither are segments of which less than
LEAST / (2 - LEAST) of the bigrams are in any template.

Licences of several lines or paragraphs inside a longer text are found as windows: runs of
consecutive lines within the size bounds. Only templates of which the text has LEAST / (2 - LEAST)
of the bigrams are tried; per first line the best run counts, the shortest on ties. Windows are
taken by coefficient times shared bigrams, unless they touch a window of the same template or lie
by more than half in matches taken before, lines, paragraphs and whole text first.

A segment's licence is the template with the highest coefficient, the longer one on ties, then
the first listed. Null and empty texts, and segments of fewer than two words, match nothing.
Repeated rows are each returned. Empty tables give empty results. Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gigmesh.llm import textbytes as tb
from gigmesh.llm.licence_templates import TEMPLATES

LEAST = 0.8
_NEWLINE = 10
MATCH = "struct<licence:string,score:double,begin:bigint,finish:bigint>"


def bigrams(hashes: np.ndarray) -> np.ndarray:
    return np.unique(tb.windows(hashes, 2))


def _words(data: np.ndarray, offsets: np.ndarray):
    data = tb.LOWER[data]
    starts, ends, bounds = tb.find_words(data, offsets, tb.ALNUM)
    return starts, ends, bounds, tb.word_hashes(data, starts, ends)


class Templates:
    """Bigram sets of the templates, ordered by size."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        sets = []
        for at, (name, text) in enumerate(templates):
            raw = np.frombuffer(text.encode(), np.uint8)
            sets.append((bigrams(_words(raw, np.array([0, len(raw)]))[3]), name, at))
        sets = sorted((x for x in sets if len(x[0])), key=lambda x: len(x[0]))
        self.sets, self.names, self.order = ([x[k] for x in sets] for k in range(3))
        self.sizes = np.array([len(x) for x in self.sets])
        self.any = np.unique(np.concatenate(self.sets)) if sets else np.zeros(0, np.uint64)
        # Per bigram of `any`, the templates that have it.
        places = np.concatenate([np.searchsorted(self.any, x) for x in self.sets]) if sets else np.zeros(0, np.int64)
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(places, kind="stable")]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=len(self.any)))])

    def known(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.any):
            return np.zeros(len(grams), bool)
        return self.any[np.minimum(np.searchsorted(self.any, grams), len(self.any) - 1)] == grams

    def best(self, grams: np.ndarray) -> tuple[float, str] | None:
        """Score and licence of the best template that the sizes allow."""
        b = len(grams)
        if self.known(grams).sum() < LEAST / (2 - LEAST) * b - 1e-9:
            return None
        lo = np.searchsorted(self.sizes, b * LEAST / (2 - LEAST) - 1e-9)
        hi = np.searchsorted(self.sizes, b * (2 - LEAST) / LEAST + 1e-9, side="right")
        top = None
        for k in range(lo, hi):
            dice = 2 * len(np.intersect1d(grams, self.sets[k], assume_unique=True)) / (b + self.sizes[k])
            if dice >= LEAST:
                rank = (dice, self.sizes[k], -self.order[k])
                top = max(top, (rank, self.names[k])) if top else (rank, self.names[k])
        return (top[0][0], top[1]) if top else None


    def within(self, grams: np.ndarray) -> np.ndarray:
        """Templates of which a text with these distinct bigrams has enough to hold a match."""
        at = np.searchsorted(self.any, grams[self.known(grams)])
        first, count = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        which = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        shared = np.bincount(self.owners[which], minlength=len(self.sets))
        return np.flatnonzero(shared >= LEAST / (2 - LEAST) * self.sizes - 1e-9)


def _windows(known: Templates, hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[tuple[float, float, int, int, int]]:
    """Rank, score, template, first and last line of runs of lines that reach ``LEAST``; lines are bounds in the words."""
    grams = tb.windows(hashes, 2)
    distinct, inverse = np.unique(grams, return_inverse=True)
    tried = known.within(distinct)
    if not len(tried):
        return []
    n = len(grams)
    order = np.argsort(inverse, kind="stable")
    same = inverse[order[1:]] == inverse[order[:-1]]
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    final = np.ones(n, bool)
    final[order[:-1][same]] = False
    out = []
    for k in tried.tolist():
        size = int(known.sizes[k])
        most = size * (2 - LEAST) / LEAST + 1e-9
        mine = np.isin(distinct, known.sets[k], assume_unique=True)[inverse]
        hits = np.concatenate([[0], np.cumsum(mine)])
        ends = np.flatnonzero(mine & final)
        for i in np.flatnonzero(hits[np.minimum(last, n)] > hits[np.minimum(first, n)]).tolist():
            a = int(first[i])
            left = len(ends) - int(np.searchsorted(ends, a))
            if left < LEAST / (2 - LEAST) * size - 1e-9:
                break
            width = 2 * int(most) + 64
            while True:
                new = before[a : a + width] < a
                b, shared = np.cumsum(new), np.cumsum(new & mine[a : a + width])
                if a + width >= n or b[-1] > most or shared[-1] == left:
                    break
                width *= 2
            # Bigrams of the runs from line i to each later line.
            j = i + int(np.searchsorted(last[i:], a + 2))
            stop = max(j, int(np.searchsorted(last, a + len(b) + 1, side="right")))
            if stop == j:
                continue
            upto = last[j:stop] - 2 - a
            dice = 2 * shared[upto] / (b[upto] + size)
            best = int(np.argmax(dice))
            if dice[best] >= LEAST:
                out.append((float(dice[best] * shared[upto[best]]), float(dice[best]), k, i, j + best))
    return out


def _embedded(known: Templates, hashes: np.ndarray, starts: np.ndarray, lines: list[tuple[int, int]], matches: list[dict]) -> list[dict]:
    """Windows of one text that are no copies of each other or of ``matches``; words start at ``starts``."""
    spans = np.array(lines)
    first, last = np.searchsorted(starts, spans[:, 0]), np.searchsorted(starts, spans[:, 1])
    filled = last > first
    spans, first, last = spans[filled], first[filled], last[filled]
    found = _windows(known, hashes, first, last)
    found.sort(key=lambda x: (-x[0], -x[1], known.order[x[2]], x[3]))
    taken = [(m["begin"], m["finish"]) for m in matches]
    own: dict[int, list[tuple[int, int]]] = {}
    out = []
    for _, score, k, i, j in found:
        begin, finish = int(spans[i, 0]), int(spans[j, 1])
        if any(a < finish and begin < b for a, b in own.get(k, ())):
            continue
        covered, at = 0, begin
        for a, b in sorted(taken):
            covered += max(0, min(b, finish) - max(a, at))
            at = max(at, min(b, finish))
        if 2 * covered > finish - begin:
            continue
        own.setdefault(k, []).append((begin, finish))
        taken.append((begin, finish))
        out.append({"licence": known.names[k], "score": score, "begin": begin, "finish": finish})
    return out


def _segments(text: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Byte spans of lines; of paragraphs of several lines and of the whole text."""
    breaks = np.flatnonzero(text == _NEWLINE)
    begins, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(text)]])
    filled = ends > begins
    lines = list(zip(begins[filled].tolist(), ends[filled].tolist(), strict=True))
    if not lines:
        return [], []
    new = np.flatnonzero(np.diff(np.concatenate([[False], filled]).astype(np.int8)) == 1)
    last = np.flatnonzero(np.diff(np.concatenate([filled, [False]]).astype(np.int8)) == -1)
    paragraphs = [(int(begins[a]), int(ends[b])) for a, b in zip(new, last, strict=True) if b > a]
    whole = [(lines[0][0], lines[-1][1])] if len(new) > 1 else []
    return lines, paragraphs + whole


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``doc_id, matches``: licence, score and byte span of every matching segment and window of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(templates)  # of fixed size

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(shared.value)
        kind = pa.list_(pa.struct([("licence", pa.string()), ("score", pa.float64()), ("begin", pa.int64()), ("finish", pa.int64())]))
        for batch in batches:
            for s in tb.slices(batch.column("text")):
                starts, ends, bounds, hashes = _words(s.data, s.offsets)
                hit = known.known(tb.windows(hashes, 2)) if len(hashes) > 1 else np.zeros(0, bool)
                total = np.concatenate([[0], np.cumsum(hit)])
                found = []
                for i in range(s.last - s.first):
                    a, b = bounds[i], bounds[i + 1]
                    mine = []
                    if b - a > 1 and total[b - 1] > total[a]:
                        base = s.offsets[i]
                        lines, longer = _segments(s.data[base : s.offsets[i + 1]])
                        for begin, finish in lines + longer:
                            u, v = np.searchsorted(starts, [base + begin, base + finish])
                            if v - u > 1 and total[v - 1] > total[u]:
                                best = known.best(bigrams(hashes[u:v]))
                                if best:
                                    mine.append({"licence": best[1], "score": best[0], "begin": begin, "finish": finish})
                        if len(lines) > 1:
                            mine += _embedded(known, hashes[a:b], starts[a:b] - base, lines, mine)
                    found.append(mine)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.last - s.first), pa.array(found, kind)], names=["doc_id", "matches"]
                )

    return tb.small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(look, f"doc_id bigint, matches array<{MATCH}>")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with its best match, if any."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    order = F.transform(
        "matches", lambda m: F.struct((-m["score"]).alias("k"), m["begin"].alias("begin"), m["licence"].alias("licence"), m["finish"].alias("finish"))
    )
    best = F.array_min(order)
    return found.select(
        "doc_id", F.size("matches").cast("bigint").alias("n_matches"), best["licence"].alias("licence"), (-best["k"]).alias("score"),
        best["begin"].alias("begin"), best["finish"].alias("finish"),
    )


def oracle(templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same in SQL: every line, paragraph and text against every template, without pruning."""
    quoted = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(templates))
    words = (
        "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    grams = "list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))"
    return rf"""
WITH t AS (SELECT k, licence, {grams} AS g FROM (
  SELECT k, licence, {words.format("body")} AS w FROM (VALUES {quoted}) AS v(k, licence, body))),
lines AS (
  SELECT doc_id, n, line, strlen(text) AS size,
         CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
marked AS (SELECT *, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM lines),
parts AS (
  SELECT doc_id, begin, begin + strlen(line) AS finish, line AS body FROM lines WHERE line <> ''
  UNION ALL
  SELECT doc_id, min(begin), max(begin + strlen(line)), string_agg(line, chr(10) ORDER BY n) FROM marked WHERE line <> ''
  GROUP BY doc_id, block HAVING count(*) > 1
  UNION ALL
  SELECT doc_id, min(begin), max(begin + strlen(line)), string_agg(line, chr(10) ORDER BY n) FROM marked WHERE line <> ''
  GROUP BY doc_id HAVING count(DISTINCT block) > 1),
s AS (SELECT doc_id, begin, finish, {grams} AS g FROM (SELECT *, {words.format("body")} AS w FROM parts) WHERE len(w) > 1),
scored AS (
  SELECT doc_id, begin, finish, licence, 2.0 * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) AS score, len(t.g) AS size, k FROM s, t),
best AS (
  SELECT * FROM scored WHERE score >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY doc_id, begin, finish ORDER BY score DESC, size DESC, k) = 1),
top AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM best
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, begin, licence, finish) = 1)
SELECT d.doc_id, coalesce(n, 0) AS n_matches, licence, score, begin, finish FROM documents d LEFT JOIN top USING (doc_id)
"""
