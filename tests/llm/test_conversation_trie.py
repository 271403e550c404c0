import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gigmesh.llm import conversation_trie as t

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Nodes from dictionaries of whole prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}|{role}|{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - int(np.fmod(c, 20))
        paths[c] = tuple(own.get(family, [])[:h] + said[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(own) - 1) * words(p)
    return sorted(
        (min(own), len(p), min(members[p[:-1]]) if p else -1, len(own), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(c for c in own if len(paths[c]) == len(p)))).encode()).hexdigest())
        for p, own in members.items()
    )


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def invented(n, seed, most=8, texts=3):
    r = random.Random(seed)
    return [
        (k, i, ("user", "assistant")[i % 2], " ".join(["word"] * r.randint(1, 3)) + str(r.randint(1, texts))) for k in range(n) for i in range(r.randint(1, most))
    ]


@pytest.fixture(scope="module")
def rows(spark):
    return lambda data: spark.createDataFrame(data, SCHEMA)


def test_equals_dictionaries_of_prefixes(rows):
    data = invented(300, 1)
    assert found(t.trie(t.rebuilt(rows(data)))) == plain(data)


@pytest.mark.parametrize(("segment", "shard"), [(2, 10), (3, 1), (4, 1000), (256, 17)])
def test_any_segment_and_shard_give_the_same(rows, monkeypatch, segment, shard):
    monkeypatch.setattr(t, "SEGMENT", segment)
    monkeypatch.setattr(t, "SHARD", shard)
    data = invented(120, segment, 12, 2)
    long = [(k, i, "user", f"turn {i}") for k in (1000, 1020, 1040, 1041) for i in range(11 + k % 3)]
    copies = [(c, i, "user", f"same {i}") for c in range(2000, 2300, 20) for i in range(9)]
    assert found(t.trie(t.rebuilt(rows(data + long + copies)))) == plain(data + long + copies)


def test_nulls_ties_repeats_and_families(rows):
    data = [
        (20, None, None, None), (20, None, "user", "a b"), (20, 1, "user", None), (21, 5, "user", "x"), (22, 5, "user", "x"), (22, 5, "user", "x"),
        (23, 0, "user", "x"), (-7, 0, "user", "y"), (-7, 1, "assistant", "z"), (None, 0, "user", "lost"), (25, 0, "", ""), (45, 1, "user", "alone"), (46, 1, "user", "alone"),
    ]
    assert found(t.trie(t.rebuilt(rows(data)))) == plain(data)


def test_thousands_of_copies_are_one_path(rows):
    data = [(20 * k, i, "user", f"turn {i} of all") for k in range(2000) for i in range(4)]
    got = found(t.trie(t.rebuilt(rows(data))))
    assert got == plain(data) and len(got) == 5


def test_long_texts_clashing_names_and_empty_table(rows, clashes):
    data = [(1, 0, "user", "word " * 300_000), (2, 0, "user", "word " * 300_000), (1, 1, "assistant", "x" * 2_000_000)]
    df = rows(data).select("*", *[F.lit(1).alias(x) for x in (*clashes, "key", "words", "part", "place", "skip", "level", "root")])
    assert found(t.trie(t.rebuilt(df))) == plain(data)
    assert t.trie(t.rebuilt(rows([]))).count() == 0


def test_double_array_leads_to_each_child_and_nowhere_else():
    r = random.Random(4)
    parent, ids, taken = [-1], [-1], set()
    while len(parent) < 3000:
        p, c = r.choice([0, r.randrange(len(parent))]), r.randrange(500)
        if (p, c) not in taken:
            taken.add((p, c))
            parent.append(p)
            ids.append(c)
    a = t.DoubleArray(np.array(parent), np.array(ids))
    assert len(set(a.slot.tolist())) == len(parent)
    for n in range(1, len(parent)):
        assert a.step(a.slot[[parent[n]]], np.array([ids[n]]))[0] == a.slot[n]
    for _ in range(2000):
        p, c = r.randrange(len(parent)), r.randrange(500)
        assert (a.step(a.slot[[p]], np.array([c]))[0] >= 0) == ((p, c) in taken)
