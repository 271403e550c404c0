import re

import numpy as np
import pytest

from gigmesh.llm import quality_rules as q
from gigmesh.llm import textbytes as tb

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, t in enumerate(triples) if triples.count(t) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


TEXTS = [
    None, "", " \n\t", "a b c a b c x", "ä ö ü ##|| <b>\n\nx\nx\n x\nx", "one\rtwo\x0bthree\x0cfour", "w " * 300,
    "same line here\n" * 4 + "tail", "　  wide", "1 2 3 4 5 6 1 2 3 9 9 9 9",
]


def test_base_figures_match_brute_force(table, clashes):
    docs = table(list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "no id")], **clashes)
    got = q.quality_rules(docs, docs.select("doc_id")).select("doc.doc_id", *q.FIGURES[:5], "base_failed", "kept").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text), text
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_weights_follow_the_two_multinomials(table, invent):
    good = [" ".join(invent(200, k)) for k in range(30)]
    bad = [" ".join(w.upper() + "!!" for w in invent(200, 100 + k)) for k in range(30)]
    docs = table(list(enumerate(good + bad)))
    kept = {r.doc.doc_id for r in q.quality_rules(docs, docs.where("doc_id < 15").select("doc_id")).where("kept").collect()}
    assert kept == set(range(30))


def test_counts_are_sums_over_all_rows(table, invent):
    texts = [" ".join(invent(60, k)) for k in range(9)] + [None]
    docs = table(list(enumerate(texts))).selectExpr("text", "doc_id % 2 = 0 as trusted").repartition(4)
    counts = {r.bucket: (r.raw, r.target) for r in q.gram_counts(docs).where("raw > 0").collect()}
    raw, target = np.zeros(q.BUCKETS, int), np.zeros(q.BUCKETS, int)
    for k, text in enumerate(texts):
        hashes = np.array([tb.string_hash(w) for w in (text or "").split()], np.uint64)
        both = np.bincount(q._grams(hashes), minlength=q.BUCKETS)
        raw += both
        target += both * (k % 2 == 0)
    assert counts == {b: (raw[b], target[b]) for b in np.flatnonzero(raw)}


def test_empty_tables(table):
    docs = table([])
    assert q.quality_rules(docs, docs.select("doc_id")).count() == 0
    some = table([(1, "a b")])
    assert q.quality_rules(some, docs.select("doc_id")).count() == 1


@pytest.mark.parametrize("size", [1, 7, 300, 1 << 22])
def test_word_hashes_depend_on_bytes_alone(size):
    words = ["x" * (tb._BLOCK + 5), "ab", "x" * (tb._BLOCK + 5), "é", "ab", "b"]
    raw = np.frombuffer(("-" * size + "-".join(words)).encode(), np.uint8)
    starts, ends, _ = tb.find_words(raw, np.array([0, len(raw)]), tb.ALNUM)
    hashes = tb.word_hashes(raw, starts, ends)
    assert hashes.tolist() == [tb.string_hash(w) for w in words]
    assert len(set(hashes.tolist())) == 4
