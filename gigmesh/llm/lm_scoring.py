"""Language-model scores: causal self-attention over subword ids, and a unigram base.

A text's tokens are its words, lower-cased in A-Z, and one end. Base: every token by its count in
the training texts, plus one, over all counts. Model: a word is its subwords, each the longest
vocabulary token, of ``PIECE`` bytes at most, that the rest of the word starts with. Those that begin a word and those that
go on in one are told apart, so attention predicts every subword, every word's end and the text's end. Words are also known as
wholes, by their counts, and what follows a word's first subword is expected by both:

    p(token | before) = p(first id | ids before, a word begins) * (SPELLED * p(subwords that go on, then none | ids before)
                        + (1 - SPELLED) * (count + 1) / (tokens with that first id + words with it + 1)),

so scores are log10 probabilities of whole texts. The probabilities of ids are one layer of causal attention, trained in numpy; the
most frequent subwords have an id of their own (``CLASSES`` less three), the other ones that begin a word share one, and so
do those that go on; within these counts decide. The end has the last.
:func:`scores` can also be asked for a cheaper model of ``leading`` subwords alone (``CLASSES`` - 2 own ids), without spelling:

    p(token | before) = p(subword | leading subwords before) * (count + 1) / (tokens with that subword + words with it + 1).

Ids
are cut into blocks of ``BLOCK``; a window is a block and the one before it, so windows overlap by half, each
token is scored once, with at least the whole block before it to look at, and many windows are worked on as one masked batch.

Counts cover all texts and stay distributed. Only words that make up more than one in ``SHARE`` of all tokens are
broadcast (there cannot be more than ``SHARE`` of them); all others are rare by that bound, and meet their counts in a join
without frequent keys. Weights are fitted on every training text once, in ``ROUNDS`` rounds over a share of them each: every
task trains on its own share from the same weights, and a distributed mean over tasks, weighted by tokens, ends the round.

Words are told apart by 64-bit hashes. Null texts are empty and have one token, the end. Repeated rows are
each scored; a null ``doc_id`` counts as the empty text in the split. Without training texts all counts are 0.
Empty tables give empty results. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gigmesh.llm import textbytes as tb
from gigmesh.runtime import cut_lineage

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE = 3
CLASSES = 256
OTHER, END = CLASSES - 2, CLASSES - 1
#: Id that rarer subwords inside a word share, and the weight of spelling beside counts of whole words.
MORE = CLASSES - 3
SPELLED = 0.25
BEGIN, PAD = CLASSES, CLASSES + 1
DIM, BLOCK = 16, 32
SHARE = 1 << 20
ROUNDS = 2
BATCH, RATE = 16, 0.01
#: Key of the end among the words' hashes, and its subword.
END_WORD, END_PIECE = 0, -1
#: Words that a task gathers before it sums them, and windows that are scored as one batch.
GATHERED, WINDOWS = 1 << 20, 64
#: Subwords up to which all words of a slice are cut together.
STEPS = 32
#: Numbers of subwords: twice a piece, plus 1 inside a word.
NUMBERS = 1 << 17


# -- subwords ----------------------------------------------------------------------------


def read_pieces(path: str) -> list[tuple[bytes, int]]:
    """Vocabulary tokens of at most ``PIECE`` bytes with their ids, shorter ones first."""
    with open(path, "rb") as f:
        ranks = [(base64.b64decode(token), int(rank)) for token, rank in (line.split() for line in f if line.strip())]
    return sorted([(t, r) for t, r in ranks if len(t) <= PIECE and 0 not in t[1:]], key=lambda x: len(x[0]))


def piece_table(pieces: list[tuple[bytes, int]], kind: type = np.uint16) -> np.ndarray:
    """Id of the longest piece that three bytes start with; zeros stand for bytes after a word's end."""
    table = np.zeros((256, 256, 256), kind)
    for token, rank in pieces:
        table[tuple(token)] = rank
    return table.reshape(-1)


class Words:
    """Words of a slice of texts: hashes, codes of their first three bytes, and each text's bounds."""

    def __init__(self, s: tb.Slice) -> None:
        data = tb.LOWER[s.data]
        self.starts, self.ends, self.bounds = tb.find_words(data, s.offsets, tb.SPACED)
        self.hashes = tb.word_hashes(data, self.starts, self.ends).view(np.int64)
        self.data = np.concatenate([data, np.zeros(2, np.uint8)])
        self.codes = self.codes_at(self.starts, self.ends)

    def codes_at(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Codes of the three bytes from ``at``, zeros behind the words' ``ends``."""
        codes = self.data[at].astype(np.int32) << 16
        for k in (1, 2):
            codes |= np.where(at + k < ends, self.data[at + k], 0).astype(np.int32) << (16 - 8 * k)
        return codes


def subwords(w: Words, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All subwords of a slice in order, as twice their piece, plus 1 inside a word; and each word's number of them.

    ``table`` and ``lengths`` are pieces and their bytes by code.
    """
    at, word, found = w.starts, np.arange(len(w.starts)), []
    for step in range(STEPS):
        codes = w.codes_at(at, w.ends[word])
        found.append((word, table[codes].astype(np.int64) * 2 + (step > 0)))
        at = at + lengths[codes]
        on = at < w.ends[word]
        at, word = at[on], word[on]
        if not len(at):
            break
    for k, first in zip(word.tolist(), at.tolist(), strict=True):  # the rest of words of very many subwords
        spots = np.arange(first, w.ends[k])
        codes = w.codes_at(spots, np.full(len(spots), w.ends[k]))
        steps, taken, i = lengths[codes].tolist(), [], 0
        while i < len(steps):
            taken.append(i)
            i += steps[i]
        found.append((np.full(len(taken), k), table[codes[taken]].astype(np.int64) * 2 + 1))
    words, numbers = (np.concatenate(c) for c in zip(*found, strict=True))
    return numbers[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(w.starts))


def split(docs: DataFrame) -> DataFrame:
    """``doc_id, text, held_out`` and ``share``, a number below ``ROUNDS`` that deals out training texts."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", (F.crc32(F.encode(name, "utf-8")) % 7 == 2).alias("held_out"),
        F.pmod(F.xxhash64(name), F.lit(max(1, ROUNDS))).cast("int").alias("share"),
    )


def count_words(docs: DataFrame, pieces: list[tuple[bytes, int]]) -> DataFrame:
    """``word, piece, n, seen``: a word's count in training texts and in all."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = None, [], 0

        def summed() -> pa.RecordBatch:
            words, codes, train = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(words, kind="stable")
            words, codes, train = words[order], codes[order], train[order]
            first = np.flatnonzero(np.diff(words, prepend=words[0] - 1 if len(words) else 0))
            n, seen = np.add.reduceat(train, first), np.diff(np.append(first, len(words)))
            piece = np.where(words[first] == END_WORD, END_PIECE, table[codes[first]].astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(words[first]), pa.array(piece), pa.array(n), pa.array(seen.astype(np.int64))], names=["word", "piece", "n", "seen"])

        for batch in batches:
            table = piece_table(pieces) if table is None else table
            train = ~np.asarray(batch.column("held_out"))
            for s in tb.slices(batch.column("text")):
                w, own = Words(s), train[s.first : s.last].astype(np.int64)
                held.append((w.hashes, w.codes, np.repeat(own, np.diff(w.bounds))))
                held.append((np.full(len(own), END_WORD, np.int64), np.zeros(len(own), np.int32), own))
                size += len(w.hashes) + len(own)
                if size >= GATHERED:
                    yield summed()
                    held, size = [], 0
        if size:
            yield summed()

    found = tb.small_batches(docs.select("text", "held_out")).mapInArrow(counted, "word bigint, piece int, n bigint, seen bigint")
    return found.groupBy("word").agg(F.min("piece").alias("piece"), F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def count_subwords(docs: DataFrame, pieces: list[tuple[bytes, int]]) -> DataFrame:
    """``number, n``: the subwords of all training texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, total = None, np.zeros(NUMBERS, np.int64)
        for batch in batches:
            cut = cut or cutter(pieces)
            for s in tb.slices(batch.column("text")):
                total += np.bincount(cut(Words(s))[0], minlength=NUMBERS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], names=["number", "n"])

    found = tb.small_batches(docs.where(~F.col("held_out")).select("text")).mapInArrow(counted, "number int, n bigint")
    return found.groupBy("number").agg(F.sum("n").alias("n"))


def cutter(pieces: list[tuple[bytes, int]]) -> Callable[[Words], tuple[np.ndarray, np.ndarray]]:
    """:func:`subwords` with its tables."""
    table, lengths = piece_table(pieces), np.maximum(piece_table([(t, len(t)) for t, _ in pieces], np.uint8), 1)
    return lambda w: subwords(w, table, lengths)


# -- attention ----------------------------------------------------------------------------

#: Weights: query, key, value and direct vectors of the ids, of places in the block and in the window, and what vectors say of the next id.
SHAPES = {
    **{name: (CLASSES + 2, DIM) for name in ("q", "k", "v", "r")}, "pq": (BLOCK, DIM), "pk": (2 * BLOCK, DIM), "out": (DIM, CLASSES), "bias": (CLASSES,),
}
SIZE = sum(math.prod(s) for s in SHAPES.values())
#: Ends of the weights in ``SHAPES``, in their order.
ENDS = np.cumsum([math.prod(s) for s in SHAPES.values()]).tolist()
#: 1 where place j of the block before and the block may be seen from place i of the block.
SEEN = (np.arange(2 * BLOCK)[None, :] <= np.arange(BLOCK)[:, None] + BLOCK).astype(np.float32)
#: Logarithms beyond this are cut off before they become powers.
LARGEST = 60
#: Places of an id's numbers in a flat table of vectors.
SPOTS = np.arange((CLASSES + 2) * DIM).reshape(-1, DIM)
#: Rows of logits that are worked on at once, so that they stay in a core's cache.
NEAR = 256


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the weights, or of their gradient, by name."""
    return {name: flat[end - math.prod(s) : end].reshape(s) for (name, s), end in zip(SHAPES.items(), ENDS, strict=True)}


def rows_of(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return table.take(ids, 0, mode="clip")


def summed_rows(spots: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of vectors by id below ``n``; ``spots`` are the ``SPOTS`` of each vector's id."""
    return np.bincount(spots.ravel(), rows.ravel(), n * DIM).reshape(n, DIM)


class Attention:
    """One layer of causal attention; ``prior`` are the log frequencies of ids in all training texts.

    Vectors that are multiplied by all ids or places carry one more number, so that a sum of weights or a bias comes
    out of the same product. Large tables of weights are never divided by their sums, the vectors made of them are.
    """

    def __init__(self, flat: np.ndarray, prior: np.ndarray) -> None:
        self.flat, self.prior = flat.astype(np.float32), prior.astype(np.float32)
        self.p = parts(self.flat)
        self.mean, self.square, self.grad, self.steps = *np.zeros((3, SIZE), np.float32), 0
        self.g = parts(self.grad)
        self.near = np.empty((NEAR, CLASSES), np.float32)

    @staticmethod
    def fresh() -> np.ndarray:
        return np.random.default_rng(13).normal(0, 0.15, SIZE).astype(np.float32)

    def attend(self, x: np.ndarray) -> tuple:
        """``x`` (windows, 2 * BLOCK): ids before each place. Returns what training needs, last the hidden vectors, each with a 1."""
        p, last = self.p, x[:, BLOCK:]
        values = np.ones((CLASSES + 2, DIM + 1), np.float32)
        values[:, :DIM] = p["v"]
        values[PAD] = 0  # neither its value nor its weight counts
        q, k, v = rows_of(p["q"], last), rows_of(p["k"], x), rows_of(values, x)
        q += p["pq"]
        q *= DIM**-0.5
        k += p["pk"]
        a = np.matmul(q, k.transpose(0, 2, 1))
        if not a.max(initial=0) <= LARGEST:
            np.minimum(a, LARGEST, out=a)
        np.exp(a, out=a)
        a *= SEEN
        o = np.matmul(a, v)
        z = 1 / (o[..., DIM:] + np.float32(1e-30))
        o = o[..., :DIM] * z
        h = np.ones((*o.shape[:2], DIM + 1), np.float32)
        np.tanh(o + rows_of(p["r"], last), out=h[..., :DIM])
        return q, k, v, a, o, z, h

    def outward(self) -> tuple[np.ndarray, bool]:
        """What hidden vectors say of the next id, with a row for their 1, and whether logits can be too large."""
        out = np.concatenate([self.p["out"], (self.p["bias"] + self.prior)[None]])
        return out, not (np.abs(out[:DIM]).sum(0) + out[DIM]).max() <= LARGEST  # hidden numbers are between -1 and 1

    def logits(self, h: np.ndarray, out: np.ndarray, large: bool) -> np.ndarray:
        """Logarithms of the ids' weights, for at most ``NEAR`` hidden vectors, until the next call."""
        e = np.matmul(h, out, out=self.near[: len(h)])
        return np.minimum(e, LARGEST, out=e) if large else e

    def predict(self, x: np.ndarray, y: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms of the probabilities of ids ``y`` but PAD, in a row, and of all ids of the columns ``among`` at each place."""
        real = y != PAD
        h, ids, (out, large) = self.attend(x)[-1][real], y[real], self.outward()
        found, mass = np.empty(len(ids)), np.empty((len(ids), among.shape[1]))
        for at in range(0, len(ids), NEAR):
            e, near = self.logits(h[at : at + NEAR], out, large), slice(at, at + NEAR)
            own = e[np.arange(len(e)), ids[near]]
            np.exp(e, out=e)
            total = np.log(e.sum(-1), dtype=np.float64)
            found[near] = own - total
            if mass.shape[1]:
                mass[near] = np.log(e @ among, dtype=np.float64) - total[:, None]
        return found, mass

    def log_probabilities(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of ids ``y``; 0 for PAD."""
        full = np.zeros(y.shape)
        full[y != PAD] = self.predict(x, y, np.empty((CLASSES, 0), np.float32))[0]
        return full

    def learn(self, x: np.ndarray, y: np.ndarray) -> None:
        """One step of Adam on the mean cross entropy."""
        q, k, v, a, o, z, h = self.attend(x)
        p, g, real = self.p, self.g, y != PAD
        h, ids, (out, large) = h[real], y[real], self.outward()
        back, share = np.concatenate([p["out"], np.ones((1, CLASSES), np.float32)]).T.copy(), np.float32(1 / max(1, len(ids)))
        found, slope = np.zeros((CLASSES, DIM + 1), np.float32), np.empty((len(ids), DIM), np.float32)
        for at in range(0, len(ids), NEAR):
            e, near = self.logits(h[at : at + NEAR], out, large), slice(at, at + NEAR)
            np.exp(e, out=e)
            sums = e @ back
            each = share / sums[:, DIM:]
            found += e.T @ (h[near] * each)
            np.multiply(sums[:, :DIM], each, out=slope[near])
        slope -= rows_of(p["out"].T * share, ids)
        h, found = h[:, :DIM], found.T
        slope *= 1 - h * h
        g["out"][:] = found[:DIM] - share * summed_rows(SPOTS[ids], h, CLASSES).T
        g["bias"][:] = found[DIM] - share * np.bincount(ids, minlength=CLASSES)
        dz = np.zeros(o.shape, np.float32)
        dz[real] = slope
        dn = np.empty((*dz.shape[:2], DIM + 1), np.float32)
        np.multiply(dz, z, out=dn[..., :DIM])
        np.negative((dn[..., :DIM] * o).sum(-1), out=dn[..., DIM])
        ds = np.matmul(dn, v.transpose(0, 2, 1))
        ds *= a
        dq, dk, dv = np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q), np.matmul(a.transpose(0, 2, 1), dn[..., :DIM])
        dq *= DIM**-0.5
        spots = rows_of(SPOTS, x)
        last = spots[:, BLOCK:].ravel()
        for name, of, rows in (("r", last, dz), ("q", last, dq), ("k", spots, dk), ("v", spots, dv)):
            g[name][:] = summed_rows(of, rows, CLASSES + 2)
        g["v"][PAD] = 0
        g["pq"][:], g["pk"][:] = dq.sum(0), dk.sum(0)
        self.steps += 1
        self.mean += 0.1 * (self.grad - self.mean)
        self.square += 0.01 * (self.grad * self.grad - self.square)
        size = np.sqrt(self.square)
        size *= (1 - 0.99**self.steps) ** -0.5
        size += 1e-8
        np.divide(self.mean, size, out=size)
        size *= RATE / (1 - 0.9**self.steps)
        self.flat -= size


def windows(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of several texts (each with its end) as windows ``x``, ``y`` and each window's text."""
    length = np.diff(bounds)
    blocks = -(-length // BLOCK)
    first = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(length)), blocks)
    spot = np.repeat(first * BLOCK - bounds[:-1], length) + np.arange(len(ids))
    y = np.full(int(blocks.sum()) * BLOCK, PAD, np.int64)
    x = y.copy()
    y[spot] = ids
    x[spot[1:]] = ids[:-1]
    x[first * BLOCK] = BEGIN
    x, y = x.reshape(-1, BLOCK), y.reshape(-1, BLOCK)
    before = np.concatenate([np.full((1, BLOCK), PAD), x[:-1]])
    before[first] = PAD
    return np.concatenate([before, x], 1), y, text


def class_ids(w: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a slice's words, with an end after each text, and the texts' bounds."""
    bounds = w.bounds + np.arange(len(w.bounds))
    ids = np.full(bounds[-1], END, np.int64)
    ids[np.arange(len(w.codes)) + np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))] = table[w.codes]
    return ids, bounds


class Model:
    """What tasks need to score: pieces and their classes, counts of frequent words, counts by class, weights."""

    def __init__(self, pieces: list[tuple[bytes, int]], rows: list) -> None:
        """``rows`` are ``piece, tokens, words`` of all training texts: one per piece that occurs."""
        ranked = sorted([r for r in rows if r["piece"] != END_PIECE and r["tokens"]], key=lambda r: (-r["tokens"], r["piece"]))
        self.pieces, self.classes = pieces, {r["piece"]: k for k, r in enumerate(ranked[:OTHER])}
        tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in rows:
            k = END if r["piece"] == END_PIECE else self.classes.get(r["piece"], OTHER)
            tokens[k] += r["tokens"]
            words[k] += r["words"]
        self.n, self.v, self.ends = int(tokens.sum()), int(words.sum()), int(tokens[END])
        self.prior = np.log((tokens + 1) / (tokens.sum() + CLASSES))
        self.within = np.log10(tokens + words + 1)
        self.weights = Attention.fresh()
        self.words = self.counts = np.zeros(0, np.int64)

    def table(self) -> np.ndarray:
        """Class by the code of a word's first three bytes."""
        classes = [(token, self.classes.get(rank, OTHER)) for token, rank in [(b"", 0), *self.pieces]]  # codes without a piece count as piece 0
        return piece_table(classes, np.uint8)


    def reader(self) -> Callable[[Words], tuple]:
        """From words to ids and the texts' bounds."""
        table = self.table()
        return lambda w: class_ids(w, table)

    def expected(self, net: Attention, w: Words, read: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's part of the score before words' counts, and ``a``, ``b`` of each word, which adds log10(a * (count + 1) + b)."""
        x, y, text = windows(*read)
        own = np.concatenate([net.log_probabilities(x[at : at + WINDOWS], y[at : at + WINDOWS]).sum(1) for at in range(0, len(x), WINDOWS)])
        ids, bounds = read
        sums = np.bincount(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), self.within[ids], minlength=len(bounds) - 1)
        return np.bincount(text, own) / math.log(10) - sums + math.log10(self.ends + 1), np.ones(len(w.codes)), np.zeros(len(w.codes))


class Subwords(Model):
    """The same for all subwords, and what rarer ones are expected within the id that they share."""

    def __init__(self, pieces: list[tuple[bytes, int]], rows: list, found: list) -> None:
        """``found`` are ``number, n`` of all training texts."""
        super().__init__(pieces, rows)
        counts = np.zeros(NUMBERS)
        for r in found:
            counts[r["number"]] = r["n"]
        self.own = np.array([r["number"] for r in sorted(found, key=lambda r: (-r["n"], r["number"]))[:MORE]], np.int64)
        self.ids = np.where(np.arange(NUMBERS) % 2, MORE, OTHER).astype(np.uint8)
        self.ids[self.own] = np.arange(len(self.own))
        tokens, words, held = np.zeros(CLASSES), np.zeros(CLASSES), np.bincount(self.ids, counts, CLASSES)
        for r in rows:
            k = END if r["piece"] == END_PIECE else self.ids[2 * r["piece"]]
            tokens[k] += r["tokens"]
            words[k] += r["words"]
        held[END] = self.ends
        self.prior = np.log((held + 1) / (held.sum() + CLASSES))
        self.whole = (1 - SPELLED) / (tokens + words + 1)
        kinds = len({0, *(rank for _, rank in pieces)})  # codes without a piece count as piece 0
        self.among = np.zeros((CLASSES, 1), np.float32)
        self.among[[*np.flatnonzero(self.own % 2 == 0), OTHER, END]] = 1
        self.shared = np.zeros(NUMBERS)
        for k in (OTHER, MORE):
            rarer, own = self.ids == k, (self.own % 2 == (k == MORE)).sum()
            self.shared[rarer] = np.log10((counts[rarer] + 1) / max(held[k] + kinds - own, 1))

    def reader(self) -> Callable[[Words], tuple]:
        cut = cutter(self.pieces)

        def read(w: Words) -> tuple:
            numbers, times = cut(w)
            spots = np.concatenate([[0], np.cumsum(times)])
            bounds = spots[w.bounds] + np.arange(len(w.bounds))
            ids = np.full(bounds[-1], END, np.int64)
            text = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
            first = spots[:-1] + text  # place of each word's first subword
            ids[np.arange(len(numbers)) + np.repeat(text, times)] = self.ids[numbers]
            return ids, bounds, numbers, times, first

        return read

    def expected(self, net: Attention, w: Words, read: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, bounds, numbers, times, first = read
        x, y, _ = windows(ids, bounds)
        parts = [net.predict(x[at : at + WINDOWS], y[at : at + WINDOWS], self.among) for at in range(0, len(x), WINDOWS)]
        own, begins = (np.concatenate(c) / math.log(10) for c in zip(*parts, strict=True))
        begins = begins[:, 0]
        # Ids that begin a word, and ends, are expected among each other; that none goes on belongs to the word before.
        heads = np.concatenate([first, bounds[1:] - 1])
        text = np.concatenate([np.repeat(np.arange(len(bounds) - 1), np.diff(w.bounds)), np.arange(len(bounds) - 1)])
        sums = np.bincount(text, own[heads] - begins[heads], minlength=len(bounds) - 1)
        word = np.repeat(np.arange(len(times)), times)
        going = own[np.arange(len(numbers)) + text[word]]
        going[first - text[: len(first)]] = 0
        spelled = np.bincount(word, going + self.shared[numbers], minlength=len(times)) + begins[first + times]
        return sums, self.whole[ids[first]], SPELLED * 10.0 ** spelled


# -- fitting and scoring ----------------------------------------------------------------------


def trained(docs: DataFrame, model: Model, turn: int) -> np.ndarray:
    """Weights after a round over the training texts of share ``turn``."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(model)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, read, tokens = None, None, 0
        for batch in batches:
            if net is None and batch.num_rows:
                net, read = Attention(sent.value.weights, sent.value.prior), sent.value.reader()
            for s in tb.slices(batch.column("text")):
                x, y, _ = windows(*read(Words(s))[:2])
                order = np.random.default_rng(len(x)).permutation(len(x))
                for at in range(0, len(x), BATCH):
                    net.learn(x[order[at : at + BATCH]], y[order[at : at + BATCH]])
                tokens += int((y != PAD).sum())
        if net is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE, dtype=np.int32)), pa.array(net.flat.astype(np.float64) * tokens), pa.array(np.full(SIZE, tokens, np.int64))], names=["at", "value", "n"])

    own = docs.where(~F.col("held_out") & (F.col("share") == turn)).select("text")
    means = tb.small_batches(own).mapInArrow(learn, "at int, value double, n bigint").groupBy("at").agg((F.sum("value") / F.sum("n")).alias("mean"))
    found = means.toArrow()  # one number per weight
    out = model.weights.copy()
    out[np.asarray(found.column("at"))] = np.asarray(found.column("mean"))
    sent.unpersist()
    return out


def fit(docs: DataFrame, vocabulary: str, leading: bool = True) -> tuple[Model, DataFrame]:
    """The model, of ``leading`` subwords or of all, and the table of all words' counts."""
    pieces = read_pieces(vocabulary)
    counts = cut_lineage(count_words(docs, pieces))
    known = (F.col("n") > 0).cast("bigint")
    # One row per piece of the vocabulary at most.
    rows = counts.groupBy("piece").agg(F.sum("n").alias("tokens"), F.sum(known).alias("words"), F.sum("seen").alias("seen")).collect()
    # Two numbers per piece at most.
    model = Model(pieces, rows) if leading else Subwords(pieces, rows, count_subwords(docs, pieces).collect())
    total = counts.agg(F.sum("seen")).first()[0] or 0
    common = counts.where((F.col("seen") > total / SHARE) & (F.col("word") != END_WORD)).select("word", "n").toArrow()  # SHARE rows at most
    words, n = np.asarray(common.column("word")), np.asarray(common.column("n"))
    order = np.argsort(words)
    model.words, model.counts = words[order], n[order]
    for turn in range(ROUNDS):
        model.weights = trained(docs, model, turn)
    return model, counts


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per text: tokens, sums over frequent words and of the score, and its rare words with what :meth:`Model.expected` says of them."""
    schema = (
        "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, score double, logs double, n_known bigint, rare array<bigint>, whole array<double>, spelled array<double>"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, net = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            if net is None:
                m = sent.value
                net, read = Attention(m.weights, m.prior), m.reader()
            for s in tb.slices(batch.column("text")):
                w, n = Words(s), s.last - s.first
                predicted, whole, spelled = m.expected(net, w, read(w))
                length = np.diff(w.bounds)
                owner = np.repeat(np.arange(n), length)
                spot = np.minimum(np.searchsorted(m.words, w.hashes), max(len(m.words) - 1, 0))
                common = (m.words[spot] == w.hashes) if len(m.words) else np.zeros(len(w.hashes), bool)
                times = np.ones(len(w.hashes))  # counts of frequent words, plus 1; those of rare ones come later
                times[common] += m.counts[spot[common]]
                predicted = predicted + np.bincount(owner, np.log10(whole * times + spelled), minlength=n)
                sums = np.bincount(owner, np.log10(times), minlength=n) + math.log10(m.ends + 1)
                known = np.bincount(owner, times > 1, minlength=n).astype(np.int64) + (m.ends > 0)
                rare = ~common
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=n))]).astype(np.int32))
                columns = [
                    pa.array(row + np.arange(n)), batch.column("doc_id").slice(s.first, n), batch.column("held_out").slice(s.first, n), pa.array(length + 1),
                    pa.array(predicted), pa.array(sums), pa.array(known),
                    *(pa.ListArray.from_arrays(offsets, pa.array(c[rare])) for c in (w.hashes, whole, spelled)),
                ]
                row += n
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return tb.small_batches(docs.select("doc_id", "text", "held_out")).mapInArrow(score, schema)


def scores(docs: DataFrame, vocabulary: str = VOCABULARY, leading: bool = True) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Attention predicts the ``leading`` subword of each word, or all its subwords.
    """
    docs = split(docs)
    model, counts = fit(docs, vocabulary, leading)
    texts = cut_lineage(scored(docs, model))
    pairs = texts.select("row", F.explode(F.arrays_zip("rare", "whole", "spelled")).alias("x")).select("row", F.col("x.rare").alias("word"), "x.whole", "x.spelled")
    met = pairs.join(counts.where("n > 0").select("word", "n"), "word")
    added = F.log10(F.col("whole") * (F.col("n") + F.lit(1.0)) + F.col("spelled")) - F.log10(F.col("whole") + F.col("spelled"))
    sums = met.groupBy("row").agg(F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("more"), F.sum(added).alias("added"), F.count("*").alias("found"))
    all_logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return texts.drop("rare", "whole", "spelled").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(model.n).cast("bigint").alias("train_tokens"),
        (all_logs - F.col("n_tokens") * math.log10(model.n + model.v + 1)).alias("base_score"), (F.col("score") + F.coalesce("added", F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), leading=False)
