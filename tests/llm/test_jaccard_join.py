import random
import re
from itertools import combinations

from gigmesh.llm import jaccard_join as j
from gigmesh.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted((d if d is not None else -1, len(s), least.get(find(k)) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in j.jaccard_components(df).collect())


def corpus(invent, seed):
    r = random.Random(seed)
    rows, ids = [], iter(range(10_000))
    for base in range(12):
        text = invent(r.choice([3, 5, 6, 30, 80, 200]), seed * 100 + base)
        chain = text
        for _ in range(r.randint(1, 12)):
            copy = list(chain if r.random() < 0.5 else text)
            for _ in range(r.randint(0, max(1, len(copy) // 25))):
                copy[r.randrange(len(copy))] = "edit" + str(r.randint(0, 5))
            chain = copy
            rows.append((next(ids), " ".join(copy)))
    passage = invent(60, 5)
    rows += [(next(ids), " ".join(invent(12, 900 + k) + passage)) for k in range(15)]
    rows += [(next(ids), t) for t in (None, "", " \n", "one", "One", "one two", "a " * 300, "a " * 400)]
    r.shuffle(rows)
    return rows


def test_components_match_brute_force(table, invent, clashes):
    for seed in (1, 2, 3):
        rows = corpus(invent, seed)
        assert got(table(rows, **clashes).repartition(3)) == brute(rows)


def test_small_blocks_and_few_leaders(table, invent, monkeypatch):
    """Blocks of one or two members and no groups at all lose no link."""
    rows = corpus(invent, 4)
    want = brute(rows)
    monkeypatch.setattr(j, "BLOCK", 2)
    assert got(table(rows)) == want
    monkeypatch.setattr(j, "AGREE", 99)
    monkeypatch.setattr(j, "HEAVY", 3)
    assert got(table(rows)) == want


def test_rows_without_id_and_repeated_rows(table):
    text = "a b c d e f g h"
    rows = [(None, text), (4, text), (4, text), (2, text.upper()), (None, "x y"), (None, None), (9, "")]
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in j.jaccard_components(table(rows)).collect()]
    assert sorted(out, key=str) == sorted([(None, 4, 2), (4, 4, 2), (4, 4, 2), (2, 4, 2), (None, 1, None), (None, 0, None), (9, 0, 9)], key=str)


def test_exact_threshold(table):
    """Three quarters exactly is a link: 6 of 8 runs shared."""
    rows = [(1, "a b c d e f g h i j k"), (2, "z b c d e f g h i j k"), (3, "a b c d e f g h i j q")]
    # 1 and 2 share 6 of 8 runs; 1 and 3 too; 2 and 3 share 5 of 9.
    assert got(table(rows)) == brute(rows) == [(1, 7, 1), (2, 7, 1), (3, 7, 1)]


def test_empty_table(table):
    assert got(table([])) == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    out = dict(tuple(r) for r in components(df).collect())
    assert out == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    words = spark.createDataFrame([("b", "c"), ("c", "a")], "u string, v string")
    assert dict(tuple(r) for r in components(words).collect()) == {"a": "a", "b": "a", "c": "a"}
    assert components(df.limit(0)).count() == 0
