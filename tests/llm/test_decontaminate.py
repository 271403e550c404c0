import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gigmesh.llm import decontaminate as d
from gigmesh.llm.fm_index import Index, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, width=10):
    phrases = {}
    for item, text in items:
        w = words(text)
        size = min(width, len(w))
        for k in range(len(w) - size + 1 if size and item is not None else 0):
            phrases.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(w) - size + 1):
                found = phrases.get(tuple(w[k : k + size]))
                if found:
                    ids |= found
                    hit.update(range(k, k + size))
        out.append((len(w), len(hit), sorted(ids)))
    return out


@given(st.lists(st.lists(st.integers(0, 4), max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=4), max_size=6))
@settings(max_examples=150, deadline=None)
def test_index_finds_and_locates_every_occurrence(texts, patterns):
    hashes = np.array([11 << 40, 3 << 40, 7 << 30, (7 << 30) + 1, 9 << 50, 5 << 50], np.uint64)
    index = Index.from_bytes(Index.build([hashes[np.array(t, int)] for t in texts]).to_bytes())
    table, lengths = np.zeros((len(patterns), 4), np.uint64), np.array([len(p) for p in patterns], np.int64)
    for row, p in zip(table, patterns, strict=True):
        row[: len(p)] = hashes[np.array(p)]
    lo, hi = index.find(table, lengths)
    flat, at = [], 0
    for t in texts:
        flat.append((at, t))
        at += len(t) + 1
    for k, p in enumerate(patterns):
        want = sorted(b + i for b, t in flat for i in range(len(t) - len(p) + 1) if t[i : i + len(p)] == p)
        assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


@given(st.lists(st.integers(0, 2), min_size=1, max_size=80))
def test_suffix_array_orders_suffixes(text):
    first = np.append(np.array(text) + 1, 0)
    want = sorted(range(len(first)), key=lambda i: first[i:].tolist())
    assert suffix_array(first).tolist() == want


def test_matches_brute_force(spark, table, invent, clashes, monkeypatch):
    monkeypatch.setattr(d, "PORTION", 64)  # long texts take several portions
    items = [(k, " ".join(invent(25, k))) for k in range(6)] + [(6, "Tiny one"), (7, ""), (8, None), (None, "no id at all"), (0, " ".join(invent(12, 77)))]
    texts = [None, "", "tiny ONE, tiny one", " ".join(invent(500, 9)), "no id at all"]
    for k in range(8):
        w = invent(40 + 60 * k, 50 + k)
        w[5 + 20 * k : 5] = words(items[k % 6][1])[k : k + 12]
        texts.append(". ".join(w).upper())
    texts += [texts[5], " ".join(invent(63, 1) + words(items[1][1]) + invent(100, 2))]
    docs = table(list(enumerate(texts)) + [(None, texts[6])], **clashes)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = d.contamination(docs, bench, block=40).collect()
    assert len(got) == len(texts) + 1
    want = brute([*texts, texts[6]], items)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == want[len(texts) if r.doc_id is None else r.doc_id], r


def test_spans_are_cut(spark, table):
    bench = spark.createDataFrame([("q", "one two three four five six seven eight nine ten eleven")], "item_id string, text string")
    text = "Before, ONE two three four five six seven eight nine ten eleven! After ñ."
    docs = table([(1, text), (2, "clean text"), (3, None), (1, text)], lang="x")
    found = d.contamination(docs, bench).where("n_hit > 0")
    out = sorted((r.doc_id, r.text, r.lang) for r in d.cut_spans(docs, found).collect() if r.text)
    assert out == [(1, "Before, ! After ñ.", "x")] * 2 + [(2, "clean text", "x")]


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.contamination(table([]), none).count() == 0
    assert [r.n_hit for r in d.contamination(table([(1, "a b")]), none).collect()] == [0]


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_index_of_single_texts(n):
    hashes = np.arange(1, n + 1, dtype=np.uint64) << np.uint64(33)
    index = Index.build([hashes])
    lo, hi = index.find(hashes.reshape(-1, 1), np.ones(n, np.int64))
    assert index.locate(lo).tolist() == list(range(n)) and (hi - lo == 1).all()
