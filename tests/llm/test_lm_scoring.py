import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gigmesh.llm import lm_scoring as m
from gigmesh.llm import textbytes as tb

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def left_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def plain_base(rows):
    counts = Counter()
    for doc_id, text in rows:
        if not left_out(doc_id):
            counts.update([*words(text), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        own = [*words(text), None]
        out.append((doc_id, left_out(doc_id), len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)))
    return sorted(out, key=str), counts


@pytest.fixture(scope="module")
def docs(invent):
    r = random.Random(2)
    common = invent(40, 1)
    rows = [(i, " ".join(r.choices(common, k=r.randint(1, 90)) + invent(r.randint(0, 30), i))) for i in range(150)]
    return rows + [(900, None), (901, ""), (902, " \t\n"), (None, "No id HERE"), (None, "No id HERE"), (5, "Ünïcode wörds É here"), (903, "x" * 100_000), (904, "ab " * 40_000)]


def close(a, b):
    return len(a) == len(b) and all(x[:5] == y[:5] and math.isclose(x[5], y[5], rel_tol=1e-9) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("share", [1 << 20, 40, 1])
def test_base_equals_counting_with_frequent_and_rare_words(table, docs, monkeypatch, share, clashes):
    monkeypatch.setattr(m, "SHARE", share)
    monkeypatch.setattr(m, "ROUNDS", 0)
    monkeypatch.setattr(m, "GATHERED", 500)
    got = m.scores(table(docs, **clashes)).collect()
    found = sorted([tuple(r)[:6] for r in got], key=str)
    assert close(sorted(found, key=lambda r: str(r[:3])), sorted(plain_base(docs)[0], key=lambda r: str(r[:3])))


def test_score_equals_the_factors_one_token_at_a_time(spark, table, docs):
    rows = docs[:40] + docs[-8:-1]
    df = m.split(table(rows))
    model, _ = m.fit(df, m.VOCABULARY)
    net, classes, pieces = m.Attention(model.weights, model.prior), model.classes, dict(m.read_pieces(m.VOCABULARY))
    _, counts = plain_base(rows)

    def class_of(word):
        raw = word.encode()
        return classes.get(next(pieces[raw[:k]] for k in (3, 2, 1) if raw[:k] in pieces), m.OTHER)

    tokens, kinds = Counter(), Counter()
    for w, n in counts.items():
        k = m.END if w is None else class_of(w)
        tokens[k] += n
        kinds[k] += 1

    def plain(text):
        own = [*words(text), None]
        ids = [m.END if w is None else class_of(w) for w in own]
        total, p = 0.0, {k: v.astype(np.float64) for k, v in net.p.items()}
        for t in range(len(own)):
            first = max(0, t // m.BLOCK - 1) * m.BLOCK
            seen = [m.BEGIN if j == 0 else ids[j - 1] for j in range(first, t + 1)]
            place = m.BLOCK + t % m.BLOCK
            q = p["q"][seen[-1]] + p["pq"][t % m.BLOCK]
            a = np.exp([q @ (p["k"][x] + p["pk"][place - len(seen) + 1 + j]) / 4 for j, x in enumerate(seen)])
            h = np.tanh(a @ p["v"][seen] / a.sum() + p["r"][seen[-1]])
            e = np.exp(h @ p["out"] + p["bias"] + model.prior)
            total += math.log10(e[ids[t]] / e.sum()) + math.log10((counts[own[t]] + 1) / (tokens[ids[t]] + kinds[ids[t]] + 1))
        return total

    got = {r.doc_id: r.score for r in m.scores(table(rows)).collect()}
    for doc_id, text in rows:
        if doc_id is not None and doc_id != 5 and doc_id < 903:
            assert math.isclose(got[doc_id], plain(text), rel_tol=2e-5, abs_tol=1e-4), doc_id


def test_every_token_is_scored_once_and_sees_only_what_comes_before():
    ids, bounds = np.arange(200) % 50, np.array([0, 1, 70, 70 + 64, 200])
    x, y, text = m.windows(ids, bounds)
    assert sorted(y[y != m.PAD].tolist()) == sorted(ids.tolist())
    assert np.bincount(text[np.nonzero(y != m.PAD)[0]]).tolist() == np.diff(bounds).tolist()
    net = m.Attention(m.Attention.fresh() * 5, np.zeros(m.CLASSES))
    before = net.log_probabilities(x, y)
    changed = ids.copy()
    changed[40:] = 7
    x2, y2, _ = m.windows(changed, bounds)
    after = net.log_probabilities(x2, np.where(y2 == m.PAD, m.PAD, y))
    old = np.cumsum((y != m.PAD).ravel()).reshape(y.shape) <= 40
    assert np.allclose(before[old], after[old], atol=1e-6) and not np.allclose(before, after)


def test_probabilities_of_all_ids_sum_to_one():
    net = m.Attention(m.Attention.fresh() * 3, np.log(np.random.default_rng(1).dirichlet(np.ones(m.CLASSES))))
    x = np.random.default_rng(2).integers(0, m.CLASSES, (3, 2 * m.BLOCK))
    total = sum(np.exp(net.log_probabilities(x, np.full((3, m.BLOCK), k))) for k in range(m.CLASSES))
    assert np.allclose(total, 1, atol=1e-4)


def test_gradient_points_down():
    r = np.random.default_rng(3)
    x = r.integers(0, m.CLASSES, (4, 2 * m.BLOCK))
    x[0, : m.BLOCK] = m.PAD
    y = r.integers(0, m.CLASSES, (4, m.BLOCK))
    y[1, 20:] = m.PAD
    start = m.Attention.fresh()
    loss = lambda flat: -m.Attention(flat, np.zeros(m.CLASSES)).log_probabilities(x, y).sum() / (y != m.PAD).sum()
    net = m.Attention(start.copy(), np.zeros(m.CLASSES))
    net.learn(x, y)
    grad = net.mean / 0.1
    for at in r.choice(np.flatnonzero(np.abs(grad) > 1e-4), 30, replace=False):
        step = np.zeros(m.SIZE, np.float32)
        step[at] = 0.02
        slope = (loss(start + step) - loss(start - step)) / 0.04
        assert math.isclose(slope, grad[at], rel_tol=0.1, abs_tol=3e-4)


def test_leading_subword_is_the_longest_known_prefix():
    pieces = m.read_pieces(m.VOCABULARY)
    known, table_ = dict(pieces), m.piece_table(pieces)
    raw = "the of né x 日本 zq9 a".encode()
    w = m.Words(tb.Slice(0, 1, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    assert table_[w.codes].tolist() == [known[next(x[:k] for k in (3, 2, 1) if x[:k] in known)] for x in raw.split()]


def test_training_lowers_the_cost_of_held_out_texts(spark):
    got = m.query(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.2 * got[2]


def test_empty_tables_and_no_training_text(table):
    assert m.scores(table([])).count() == 0
    out = next(k for k in range(100) if left_out(k))
    (r,) = m.scores(table([(out, "two words")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0


def test_every_training_text_trains_once(table, docs, monkeypatch):
    turns = []

    def trained(split, model, turn):
        turns.extend((r["doc_id"], r["text"]) for r in split.where(~F.col("held_out") & (F.col("share") == turn)).select("doc_id", "text").collect())
        return model.weights

    monkeypatch.setattr(m, "trained", trained)
    m.fit(m.split(table(docs)), m.VOCABULARY)
    assert sorted(turns, key=str) == sorted(((i, t) for i, t in docs if not left_out(i)), key=str)


def plain_gradient(flat, prior, x, y):
    """Mean cross entropy's gradient by the formulas, with whole tables."""
    p, g = m.parts(flat.astype(np.float64)), {k: np.zeros(s) for k, s in m.SHAPES.items()}
    last, scale, n = x[:, m.BLOCK :], m.DIM**-0.5, (y != m.PAD).sum()
    q, k, v = p["q"][last] + p["pq"], p["k"][x] + p["pk"], p["v"][x]
    a = np.exp(q @ k.transpose(0, 2, 1) * scale) * (np.arange(2 * m.BLOCK) <= np.arange(m.BLOCK)[:, None] + m.BLOCK) * (x != m.PAD)[:, None, :]
    a /= a.sum(-1, keepdims=True)
    h = np.tanh(a @ v + p["r"][last])
    e = np.exp(h @ p["out"] + p["bias"] + prior)
    e /= e.sum(-1, keepdims=True)
    e = (e - (y[..., None] == np.arange(m.CLASSES))) * (y != m.PAD)[..., None] / n
    g["out"], g["bias"] = np.einsum("wbd,wbc->dc", h, e), e.sum((0, 1))
    dz = e @ p["out"].T * (1 - h * h)
    da = dz @ v.transpose(0, 2, 1)
    ds = a * (da - (a * da).sum(-1, keepdims=True)) * scale
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    for name, at, rows in (("r", last, dz), ("q", last, dq), ("k", x, dk), ("v", x, a.transpose(0, 2, 1) @ dz)):
        np.add.at(g[name], at, rows)
    g["pq"], g["pk"] = dq.sum(0), dk.sum(0)
    return np.concatenate([g[k].ravel() for k in m.SHAPES])


def invented_windows(count):
    r = np.random.default_rng(8)
    lengths = r.integers(1, 5 * m.BLOCK, count)
    return m.windows(r.integers(0, m.CLASSES, lengths.sum()), np.append(0, np.cumsum(lengths)))[:2]


@pytest.mark.parametrize("spread", [1, 6])
def test_gradient_equals_the_formulas(spread):
    x, y = invented_windows(9)
    flat, prior = m.Attention.fresh() * spread, np.log(np.random.default_rng(1).dirichlet(np.ones(m.CLASSES)))
    net = m.Attention(flat.copy(), prior)
    net.learn(x, y)
    want = plain_gradient(flat, prior, x, y)
    assert np.allclose(net.mean / 0.1, want, atol=1e-6 + 1e-4 * np.abs(want).max())


@pytest.mark.parametrize(("work", "tables"), [("learn", 2.5), ("log_probabilities", 1.25)])
def test_logits_are_worked_on_in_parts(work, tables):
    """Memory in tables of all logits: 2.9 and 1.7 when there was such a table, 2.2 and 0.8 without; the rest is attention's."""
    x, y = (t[: 2 * m.BATCH] for t in invented_windows(60))
    net = m.Attention(m.Attention.fresh(), np.zeros(m.CLASSES))
    getattr(net, work)(x, y)
    tracemalloc.start()
    getattr(net, work)(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < tables * y.size * m.CLASSES * 4


def test_too_large_logarithms_are_cut_off():
    x, y = invented_windows(3)
    net = m.Attention(m.Attention.fresh() * 400, np.zeros(m.CLASSES))
    assert np.isfinite(net.log_probabilities(x, y)).all()
    net.learn(x, y)
    assert np.isfinite(net.flat).all()


def test_codes_without_a_piece_are_classed_as_they_are_counted():
    pieces = [(b"a", 3), (b"b", 0), (b"ab", 7)]
    model = m.Model(pieces, [{"piece": k, "tokens": 9 - k, "words": 1} for k in (7, 3, 0)])
    counted, classed = m.piece_table(pieces), model.table()
    assert classed.dtype == np.uint8 and all(classed[code] == model.classes[counted[code]] for code in range(0, 1 << 24, 4099))


def test_all_subwords_are_the_longest_known_prefixes_of_what_is_left():
    pieces = m.read_pieces(m.VOCABULARY)
    known = dict(pieces)
    texts = ["the ofthe né x 日本 zq9 a", "", " \n", "x" * 1000 + " thatndou " + "ing" * 40, "é" * 90]
    raw = "".join(texts).encode()
    w = m.Words(tb.Slice(0, len(texts), np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])))
    want, times = [], []
    for word in [x for t in texts for x in t.split()]:
        left, n = word.encode(), 0
        while left:
            piece = next(left[:k] for k in (3, 2, 1) if left[:k] in known)
            want.append(2 * known[piece] + (n > 0))
            left, n = left[len(piece) :], n + 1
        times.append(n)
    numbers, found = m.cutter(pieces)(w)
    assert numbers.tolist() == want and found.tolist() == times


def test_every_subword_of_every_text_is_predicted(spark, table, docs):
    """The query's score, one subword at a time; before, what follows a word's first subword was left to counts."""
    rows = docs[:40] + docs[-8:-1]
    model, _ = m.fit(m.split(table(rows)), m.VOCABULARY, leading=False)
    p, pieces = {k: v.astype(np.float64) for k, v in m.Attention(model.weights, model.prior).p.items()}, dict(m.read_pieces(m.VOCABULARY))

    def cut(word):
        left, out = word.encode(), []
        while left:
            piece = next(left[:k] for k in (3, 2, 1) if left[:k] in pieces)
            out.append(2 * pieces[piece] + bool(out))
            left = left[len(piece) :]
        return out

    train = [words(text) for doc_id, text in rows if not left_out(doc_id)]
    counts, whole = Counter(x for t in train for w in t for x in cut(w)), Counter(w for t in train for w in t)
    own = {x: k for k, x in enumerate(sorted(counts, key=lambda x: (-counts[x], x))[: m.MORE])}
    tokens, kinds = Counter(), Counter()
    for w, n in whole.items():
        first = own.get(cut(w)[0], m.OTHER)
        tokens[first] += n
        kinds[first] += 1

    def inside(x):
        """What a subword is expected within its id."""
        if x in own:
            return 1
        rarer = sum(n for y, n in counts.items() if y % 2 == x % 2 and y not in own)
        return (counts[x] + 1) / (rarer + len(pieces) - sum(y % 2 == x % 2 for y in own))

    def plain(text):
        parts = [cut(w) for w in words(text)]
        ids = [own.get(x, m.MORE if x % 2 else m.OTHER) for q in parts for x in q] + [m.END]
        begin = [k for x, k in own.items() if x % 2 == 0] + [m.OTHER, m.END]
        p_id, p_begin = [], []
        for t in range(len(ids)):
            first = max(0, t // m.BLOCK - 1) * m.BLOCK
            seen = [m.BEGIN if j == 0 else ids[j - 1] for j in range(first, t + 1)]
            place = m.BLOCK + t % m.BLOCK
            q = p["q"][seen[-1]] + p["pq"][t % m.BLOCK]
            a = np.exp([q @ (p["k"][i] + p["pk"][place - len(seen) + 1 + j]) / 4 for j, i in enumerate(seen)])
            e = np.exp(np.tanh(a @ p["v"][seen] / a.sum() + p["r"][seen[-1]]) @ p["out"] + p["bias"] + model.prior)
            p_id.append(e[ids[t]] / e.sum())
            p_begin.append(e[begin].sum() / e.sum())
        total, t = math.log10(p_id[-1] / p_begin[-1]), 0
        for w, q in zip(words(text), parts, strict=True):
            spelled = inside(q[0]) * p_begin[t + len(q)] * math.prod(p_id[t + i] * inside(q[i]) for i in range(1, len(q)))
            known = (whole[w] + 1) / (tokens[ids[t]] + kinds[ids[t]] + 1)
            total += math.log10(p_id[t] / p_begin[t]) + math.log10(m.SPELLED * spelled + (1 - m.SPELLED) * known)
            t += len(q)
        return total

    got = {r.doc_id: r.score for r in m.scores(table(rows), leading=False).collect()}
    for doc_id, text in rows:
        if doc_id is not None and doc_id != 5 and doc_id < 903:
            assert math.isclose(got[doc_id], plain(text), rel_tol=2e-5, abs_tol=1e-4), doc_id
