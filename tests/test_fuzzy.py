import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gigmesh.functions import fuzzy
from gigmesh.operators import similar
from gigmesh.operators.similar import similar_pairs


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=90), st.text("abcé ", max_size=90))
def test_lcs_is_exact_and_symmetric(a, b):
    assert fuzzy.lcs_of(a, b) == table_lcs(a, b) == fuzzy.lcs_of(b, a)
    assert 0 <= fuzzy.ratio_of(a, b) <= 100


@pytest.mark.parametrize(
    "a, b, expected",
    [("", "", 100.0), ("", "abc", 0.0), ("abc", "abc", 100.0), ("abcd", "abxd", 75.0), ("the jam", "the jams", 100 * 14 / 15)],
)
def test_ratio(a, b, expected):
    assert fuzzy.ratio_of(a, b) == pytest.approx(expected)


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("", "", 100.0),
        ("", "x", 0.0),
        ("elf", "club delf live", 100.0),
        ("abcd", "xxabxdxx", 75.0),
        # A prefix window shorter than the needle: 2*9/(10+9).
        ("0123456789", "123456789zzzzzzzzzzz", 100 * 18 / 19),
    ],
)
def test_partial_ratio(a, b, expected):
    assert fuzzy.partial_of(a, b) == pytest.approx(expected)
    assert fuzzy.partial_of(b, a) == pytest.approx(expected)


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ("", "", 0.0),
        ("a b", "", 0.0),
        ("fuzzy was a bear", "fuzzy fuzzy was a bear", 100.0),
        ("new york mets", "mets new york vs braves", 100.0),
        # Nothing shared: plain ratio of the sorted words.
        ("ab", "cd", 0.0),
        # "x" shared; best of x/xab and the joined forms: 2*1/(1+4) and 1-4/8.
        ("x ab", "x cd", 50.0),
    ],
)
def test_token_set_ratio(a, b, expected):
    assert fuzzy.token_set_of(a, b) == pytest.approx(expected)


def test_same_performer_arms(evaluate):
    a = ["club delf", "converge", "kenny wayne shepherd", "pile", None]
    b = ["club delf ft duke levine", "convergence", "shepherd kenny wayne", "krill", "pile"]
    assert evaluate(fuzzy.same_performer, a, b) == [True, True, True, False, False]


def test_sql_functions(spark):
    fuzzy.register(spark)
    row = spark.sql("SELECT indel_ratio('abcd','abxd') r, partial_ratio('b','abc') p, token_set_ratio('a b','b a') t").first()
    assert (row.r, row.p, row.t) == (75.0, 100.0, 100.0)


@pytest.mark.parametrize("percent, strict", [(80, False), (90, True), (60, False)])
def test_similarity_join_finds_every_pair(spark, percent, strict):
    import random

    rng = random.Random(percent)
    words = ["paradise", "rock", "club", "the", "sinclair", "royale", "lounge", "hall", "é", "b"]
    names = {" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(150)}
    names |= {n[:-1] + "s" for n in list(names)[:60] if len(n) > 2} | {"", "a", "ab", "ba"}
    got = {tuple(r) for r in similar_pairs(spark.createDataFrame([(n,) for n in names], "n string"), "n", percent, strict).collect()}
    at_least = lambda r: r > percent if strict else r >= percent
    want = {(a, b) for a in names for b in names if "" < a < b and at_least(fuzzy.ratio_of(a, b))}
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=80), st.text("ab é😀\u2003\t", max_size=140), st.text("abc é😀", max_size=150)), min_size=1, max_size=40))
def test_columns_equal_plain_functions_on_any_text(spark, triples):
    clean = lambda t: "".join(c for c in t if c != "\x00" and not 0xD800 <= ord(c) < 0xE000)
    pairs = [(clean(x), clean(y)) for t in triples for x, y in ((t[0], t[1]), (t[1], t[2]), (t[0], t[0][1:]))]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    got = df.select("a", "b", fuzzy.lcs(F.col("a"), F.col("b")), fuzzy.indel_ratio("a", "b"), fuzzy.token_set_ratio("a", "b")).collect()
    for a, b, lcs, ratio, tokens in got:
        assert lcs == fuzzy.lcs_of(a, b)
        assert ratio == pytest.approx(fuzzy.ratio_of(a, b))
        assert tokens == pytest.approx(fuzzy.token_set_of(a, b))


def test_window_ratio_column_equals_plain_function(spark):
    import random

    r = random.Random(8)
    pairs = [("".join(r.choices("abc é", k=r.randint(0, 14))), "".join(r.choices("abc é", k=r.randint(0, 30)))) for _ in range(300)]
    pairs += [(b, a) for a, b in pairs[:50]] + [(a, a) for a, _ in pairs[:10]]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fuzzy.partial_ratio("a", "b"), fuzzy.same_performer("a", "b")).collect()
    for a, b, partial, same in got:
        assert partial == pytest.approx(fuzzy.partial_of(a, b)), (a, b)
        assert same == (fuzzy.ratio_of(a, b) >= 80 or fuzzy.partial_of(a, b) >= 95 or fuzzy.token_set_of(a, b) >= 95), (a, b)


def test_null_sides(spark):
    row = spark.createDataFrame([(None, "x")], "a string, b string").select(
        fuzzy.lcs(F.col("a"), F.col("b")), fuzzy.indel_ratio("a", "b"), fuzzy.partial_ratio("b", "a"), fuzzy.token_set_ratio("a", "b"), fuzzy.same_performer("a", "b")
    ).first()
    assert tuple(row) == (None, None, None, None, False)


def test_similarity_join_is_selective(spark):
    """Candidates stay under one percent of all pairs, and no key holds one percent of what is published."""
    import random

    rng = random.Random(1)
    syllables = [c + v for c in "bcdfghjklmnprstvwz" for v in "aeiou"] + ["th", "ing", "er", "st"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    names = {" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(4300)}
    names = sorted({x for n in names for x in (n, n[:-1] + "x" if rng.random() < 0.17 else n)})[:5000]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    found = similar.candidates(df, 80)
    assert found.count() < 0.01 * len(names) * (len(names) - 1) / 2
    known = similar.marked(df)
    keys = similar.posted(known, 80, True).unionByName(similar.posted(known, 80, False))
    most, total = keys.groupBy("key").count().agg(F.max("count"), F.sum("count")).first()
    assert most < 0.01 * total
    got = {tuple(r) for r in similar_pairs(df, "s").collect()}
    letters = sorted(set("".join(names)))
    counts = np.array([[n.count(c) for c in letters] for n in names], np.int16)
    length, want = counts.sum(1), set()
    for i, a in enumerate(names):
        shared = np.minimum(counts[i], counts[i + 1 :]).sum(1)
        for j in np.flatnonzero(200 * shared >= 80 * (length[i] + length[i + 1 :])) + i + 1:
            if fuzzy.ratio_of(a, names[j]) >= 80:
                want.add((a, names[j]))
    assert got == want


def test_no_python_in_the_plans(spark):
    df = spark.createDataFrame([("abc", "abd")], "a string, b string")
    plan = df.where(fuzzy.same_performer("a", "b") | fuzzy.ratio_at_least(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()
    plan += similar_pairs(df, "a")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_any_close(spark):
    df = spark.createDataFrame(
        [(1, ["pile", "krill"], ["krills"]), (2, ["pile"], ["bane"]), (3, None, ["x"]), (4, [], [])],
        "i int, a array<string>, b array<string>",
    )
    got = {r.i: r.r for r in df.select("i", fuzzy.any_close("a", "b").alias("r")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    assert df.select(F.max("i")).first()[0] == 4


@pytest.mark.parametrize("percent, strict, group", [(80, False, 40), (90, True, 1000), (60, False, 7)])
def test_all_pairs_equal_a_plain_loop(spark, monkeypatch, percent, strict, group):
    import random

    from gigmesh.operators import all_pairs

    r = random.Random(percent)
    names = {"".join(r.choices("0123 é日", k=r.choice([1, 3, 9, 12, 15, 16, 17, 31, 33, 64, 65, 90]))) for _ in range(130)}
    names |= {n[:-1] + "0" for n in list(names)[:60]} - {""}
    monkeypatch.setattr(all_pairs, "GROUP", group)
    monkeypatch.setattr(all_pairs, "LEFT", 11)
    monkeypatch.setattr(all_pairs, "RIGHT", 5)
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = [tuple(x) for x in all_pairs.all_pairs(df, len(names), percent, strict).collect()]
    ratio = lambda a, b: 200 * fuzzy.lcs_of(a, b) - percent * (len(a) + len(b))
    want = {(a, b) for a in names for b in names if a < b and (ratio(a, b) > 0 if strict else ratio(a, b) >= 0)}
    assert len(got) == len(set(got)) and set(got) == want


def test_numbered_names_are_not_joined_by_keys(spark, monkeypatch):
    """Numbers share keys with too many others: 6000 such names took 340 task seconds by their keys."""
    monkeypatch.setattr(similar, "BEGIN", 0)
    names = [f"{i:09d} {i % 25}" for i in range(400)]
    found = similar_pairs(spark.createDataFrame([(n,) for n in names], "n string"), "n")
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(a, b) for a in names for b in names if a < b and 200 * fuzzy.lcs_of(a, b) >= 80 * (len(a) + len(b))}
    assert {tuple(r) for r in found.collect()} == want
