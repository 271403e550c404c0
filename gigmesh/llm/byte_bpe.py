"""Byte-level BPE: recursive DuckDB queries over token positions, run inside the tasks.

A text is split by the tokenizer's pattern. A piece that is a token is that token. Each other
distinct piece of a slice becomes rows (piece, position, token), one per byte; a recursive query
joins neighbours to the merge table and contracts each piece's leftmost pair of least rank until
no pair is left. In pieces over ``LONG`` bytes, equal pairs that don't overlap are contracted in
one step, from the left: contracting one leaves the others next in line, and the number of
steps then follows the different pairs, not the length. Decoding joins ids to the
bytes of the vocabulary and concatenates them by an ordered aggregation.

Every task works alone on slices of its rows; nothing is shuffled. The vocabulary is of fixed
size and is broadcast as the bytes of its file. :func:`digests` encodes, decodes and hashes in one step,
with one database per task; what a task remembers of earlier pieces is bounded by bytes.

Any length of piece and number of pieces is allowed: a query holds at most ``PIECES`` pieces of less than
2 to the ``PLACE_BITS`` bytes, and a longer piece has a query of its own.

Null and empty texts have no tokens and decode to an empty text. Repeated rows are each
returned. Empty tables give empty results. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gigmesh.llm import textbytes as tb

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Bytes of a piece from which a step contracts all its pairs of least rank.
LONG = 128
#: Bytes of pieces and tokens that a task remembers, in two halves: the older one is forgotten when the younger is full,
#: what was met again meanwhile stays. Longer pieces are not remembered.
REMEMBERED, WORTH = 64 << 20, 512
#: Bits of a place inside a piece, and of a whole place; a rank comes above them.
PLACE_BITS, WHOLE_BITS = 24, 46
#: Bytes of texts encoded and decoded at once.
SLICE_BYTES = 1 << 20
#: DuckDB's bound, and the size of a query's peak from which it gives memory back to the system.
ENGINE = {"threads": 1, "memory_limit": "250MB", "allocator_flush_threshold": "16MB"}
#: Pieces in one query.
PIECES = 1 << (WHOLE_BITS - PLACE_BITS)

#: ``p`` is a token's place: its piece above some bits, its first byte in the piece below. A step contracts
#: one pair of each piece; pieces without a pair are done and leave.
_CONTRACT = """
WITH RECURSIVE t AS (
  SELECT w::BIGINT << {bits} | i AS p, tok, false AS done FROM bytes_of
  UNION ALL
  (WITH pairs AS (SELECT p, tok, lead(tok) OVER o AS nxt, lead(p) OVER o AS np FROM t WHERE NOT done WINDOW o AS (ORDER BY p)),
   best AS (SELECT p >> {bits} AS w, min(rank::BIGINT << {whole} | p) AS top, arg_min(np, rank::BIGINT << {whole} | p) AS np
            FROM pairs JOIN merges ON merges.pair = (tok::BIGINT << 32 | nxt) WHERE p >> {bits} = np >> {bits} GROUP BY 1)
   SELECT a.p, CASE WHEN a.p = (top & {mask}) THEN (top >> {whole})::INT ELSE a.tok END, b.w IS NULL
   FROM pairs a LEFT JOIN best b ON a.p >> {bits} = b.w WHERE b.np IS NULL OR a.p <> b.np))
SELECT p >> {bits} AS w, list(tok ORDER BY p) AS ids FROM t WHERE done GROUP BY 1
"""

#: The same for long pieces: a step contracts all pairs of least rank that don't overlap, from the left.
_CONTRACT_LONG = """
WITH RECURSIVE t AS (
  SELECT w::BIGINT << {bits} | i AS p, tok, false AS done FROM bytes_of
  UNION ALL
  (WITH pairs AS (SELECT p, tok, lead(tok) OVER o AS nxt, lead(p) OVER o AS np FROM t WHERE NOT done WINDOW o AS (ORDER BY p)),
   ranked AS (SELECT p, np, p >> {bits} AS w, rank FROM pairs JOIN merges ON merges.pair = (tok::BIGINT << 32 | nxt) WHERE p >> {bits} = np >> {bits}),
   best AS (SELECT w, min(rank) AS best FROM ranked GROUP BY w),
   hits AS (SELECT p, np, best, lag(np) OVER (ORDER BY p) IS DISTINCT FROM p AS fresh, row_number() OVER (ORDER BY p) AS n
            FROM ranked JOIN best USING (w) WHERE rank = best),
   kept AS (SELECT p, np, best FROM hits QUALIFY (n - max(CASE WHEN fresh THEN n END) OVER (ORDER BY p)) % 2 = 0)
   SELECT a.p, coalesce(k.best, a.tok), b.w IS NULL
   FROM pairs a LEFT JOIN best b ON a.p >> {bits} = b.w LEFT JOIN kept k ON a.p = k.p LEFT JOIN kept g ON a.p = g.np WHERE g.np IS NULL))
SELECT p >> {bits} AS w, list(tok ORDER BY p) AS ids FROM t WHERE done GROUP BY 1
"""

_DECODE = """
SELECT d, list(bytes ORDER BY spot) AS tokens FROM ids_of JOIN vocabulary USING (id) GROUP BY d
"""


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class Tables:
    """A task's DuckDB: the vocabulary and the merge table."""

    def __init__(self, raw: bytes) -> None:
        self.ranks = read_ranks(raw)
        self.written = {rank: str(rank) for rank in self.ranks.values()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config=ENGINE)
        tb.release()
        pairs, ranks = array("q"), array("i")
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    ranks.append(rank)
        self._load("merges", pa.table({"pair": pa.array(np.frombuffer(pairs, np.int64)), "rank": pa.array(np.frombuffer(ranks, np.int32))}))
        known = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())})
        self._load("vocabulary", known)
        del pairs, ranks, known
        tb.release()

    def close(self) -> None:
        """Give the memory back: the worker lives on, and other workers of the executor need it."""
        self.db.close()
        self.ranks, self.written = {}, {}
        tb.release()

    def _load(self, name: str, table: pa.Table) -> None:
        self.db.register("incoming", table)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming").fetchall()
        self.db.unregister("incoming")

    def _ask(self, name: str, table: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of distinct pieces."""
        out = [np.zeros(0, np.int32)] * len(pieces)
        hard: dict[tuple[str, bool], list[int]] = {}
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is None:
                hard.setdefault((_CONTRACT if len(piece) <= LONG else _CONTRACT_LONG, len(piece) >> PLACE_BITS > 0), []).append(k)
            else:
                out[k] = np.array([rank], np.int32)
        for (sql, alone), some in hard.items():
            bits, most = (WHOLE_BITS, 1) if alone else (PLACE_BITS, PIECES)
            query = sql.format(bits=bits, whole=WHOLE_BITS, mask=(1 << WHOLE_BITS) - 1)
            for at in range(0, len(some), most):
                self._contract(query, pieces, some[at : at + most], out)
        return out

    def _contract(self, sql: str, pieces: list[bytes], some: list[int], out: list[np.ndarray]) -> None:
        lengths = np.array([len(pieces[k]) for k in some])
        ends = np.cumsum(lengths)
        joined = np.frombuffer(b"".join([pieces[k] for k in some]), np.uint8)
        rows = pa.table({
            "w": pa.array(np.repeat(np.arange(len(some)), lengths)),
            "i": pa.array(np.arange(len(joined)) - np.repeat(ends - lengths, lengths)),
            "tok": pa.array(self.byte_ids[joined]),
        })
        found = self._ask("bytes_of", rows, sql)
        ids = found["ids"].combine_chunks()
        bounds, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype(np.int32)
        for k, w in enumerate(found["w"].to_pylist()):
            out[some[w]] = flat[bounds[k] : bounds[k + 1]]

    def decode(self, ids: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
        """Bytes of ``n`` id sequences; ``owner`` names the sequence of each id, in order."""
        rows = pa.table({"d": pa.array(owner.astype(np.int32)), "spot": pa.array(np.arange(len(ids), dtype=np.int32)), "id": pa.array(ids.astype(np.int32))})
        found = self._ask("ids_of", rows, _DECODE)
        out = [b""] * n
        # The bytes of a list's tokens lie one after another: a text is cut out of them.
        for owners, lists in zip(found["d"].chunks, found["tokens"].chunks, strict=True):
            tokens = lists.values.cast(pa.large_binary())
            bounds = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset :][np.asarray(lists.offsets)]
            raw = memoryview(tokens.buffers()[2] or b"")
            for d, first, last in zip(owners.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                out[d] = bytes(raw[first:last])
        return out


class Encoder:
    """Texts to ids: the pieces of a slice, new ones looked up once."""

    def __init__(self, tables: Tables, pattern: str) -> None:
        self.tables, self.split = tables, regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def ids(self, s: tb.Slice) -> list[bytes]:
        """Each text's ids, as the bytes of 32-bit numbers."""
        pieces = [self.split.findall(s.text(i).decode()) for i in range(s.last - s.first)]
        if self.held > REMEMBERED // 2:
            self.older, self.known, self.held = self.known, {}, 0
        missing = set().union(*pieces).difference(self.known)
        found = {p: self.older[p] for p in missing.intersection(self.older)}
        fresh = list(missing.difference(found))
        found.update((p, ids.tobytes()) for p, ids in zip(fresh, self.tables.encode_pieces([p.encode() for p in fresh]), strict=True))
        self.known.update(found)
        out = [b"".join(map(self.known.__getitem__, own)) for own in pieces]
        for p, ids in found.items():
            if len(p) > WORTH:
                del self.known[p]
            else:
                self.held += len(p) + len(ids) + 160
        return out


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _documents(docs: DataFrame) -> DataFrame:
    return tb.small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``docs``' ``doc_id`` and ``ids``, an array of token ids of the whole text."""
    raw = _vocabulary(docs, vocabulary)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Tables(raw.value), pattern)
            for s in tb.slices(batch.column("text"), SLICE_BYTES):
                ids = encoder.ids(s)
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.last - s.first), column], names=["doc_id", "ids"])
        if encoder:
            encoder.tables.close()

    return _documents(docs).mapInArrow(tokens, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for."""
    raw = _vocabulary(encoded, vocabulary)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for batch in batches:
            tables = tables or Tables(raw.value)
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column("ids")
                owner = np.repeat(np.arange(len(ids)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ids), 0)))
                decoded = tables.decode(np.asarray(ids.flatten()), owner, len(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])
        if tables:
            tables.close()

    return tb.small_batches(encoded.select("doc_id", "ids")).mapInArrow(texts, "doc_id bigint, ids array<int>, decoded binary")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded again."""
    raw = _vocabulary(docs, vocabulary)
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Tables(raw.value), pattern)
            written = encoder.tables.written.__getitem__
            for s in tb.slices(batch.column("text"), SLICE_BYTES):
                ids = [np.frombuffer(x, np.int32) for x in encoder.ids(s)]
                n = [len(x) for x in ids]
                decoded = encoder.tables.decode(np.concatenate(ids), np.repeat(np.arange(len(ids)), n), len(ids))
                columns = [
                    batch.column("doc_id").slice(s.first, len(ids)), pa.array(n, pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(written, x.tolist())).encode()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])
        if encoder:
            encoder.tables.close()

    return _documents(docs).mapInArrow(hashed, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token counts and digests of what is left."""
    return digests(docs)
