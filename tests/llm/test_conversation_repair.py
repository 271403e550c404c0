import functools
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gigmesh.llm import conversation_repair as c

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(conv_rows):
    """The least repair by recursion over all edits."""

    def key(r):
        said = f"{len(r[2])}|{r[2]}|{r[3]}"
        return (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(said.encode()).digest())

    rows = sorted(conv_rows, key=key)
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def least(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in grammar:
                    cost, audit, said = least(i, role[0], inserted + 1)
                    found.append((cost + 5, "I" + audit, (f"{role}:", *said)))
        if i < len(rows):
            cost, audit, said = least(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, said))
            if faults[i] not in ("blank", "duplicate"):
                stays = 5 if faults[i] else 0
                for paid, letter, role in ((0, "K", rows[i][2]), (1, "R", "user"), (1, "R", "assistant")):
                    if (state, role[:1]) in grammar:
                        cost, audit, said = least(i + 1, grammar[state, role[:1]], 0)
                        found.append((cost + paid + stays, letter + audit, (f"{role}:{rows[i][3]}", *said)))
        return min(found, default=(1 << 40, "", ()))

    cost, audit, said = least(0, "", 0)
    turns = {r[1] for r in rows} - {None}
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
    )


def expected(rows, harm=True):
    own = damaged(rows) if harm else rows
    return {conv: plain([r for r in own if r[0] == conv]) for conv in {r[0] for r in rows}}


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def invented(n, seed, most=9):
    r = random.Random(seed)
    texts = ["yes.", "no", "", " ", "why?", "well!\n", "so it is. ", "and then"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", ""]
    return [(k, t, r.choice(roles), r.choice(texts)) for k in range(n) for t in range(r.randint(1, most))]


@pytest.fixture(scope="module")
def rows(spark):
    return lambda data: spark.createDataFrame(data, SCHEMA)


def test_equals_recursion_over_all_edits(rows):
    data = invented(250, 3) + [(5000 + k, t, role, f"{t} said.") for k in range(40) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    assert found(c.repair(c.damage(rows(data)))) == expected(data)


@pytest.mark.parametrize("size", [1, 3, 7])
def test_blocks_of_any_size_give_the_same(rows, monkeypatch, size):
    monkeypatch.setattr(c, "ROWS", size)
    data = invented(40, 11, 30)
    assert found(c.repair(c.damage(rows(data)))) == expected(data)


def test_nulls_ties_repeats_and_odd_roles(rows):
    data = [
        (1, None, None, None), (1, None, "user", "a."), (1, None, "user", "a."), (1, 3, "user", "a."), (1, 3, "assistant", None),
        (None, 1, "user", "hi"), (None, None, "assistant", "yes."), (None, 4, "user", "hi"), (2, 7, None, "x."), (3, -4, "User", "x."), (3, 9, "assistant", "y."),
    ] + [(4, 2, "user", "again.")] * 6
    assert found(c.repair(c.damage(rows(data)))) == expected(data)


def test_copies_are_worked_on_as_a_count(rows):
    data = [(1, 0, "user", "a.")] * 500 + [(1, 1, "assistant", "b.")] * 300
    got = found(c.repair(rows(data).withColumn("times", F.lit(1).cast("bigint"))))
    assert got[1][1:6] == (0, 798, 0, 798, 2 * 798) and got[1][6] == "K" + "D" * 499 + "K" + "D" * 299


def test_every_conversation_is_returned_even_when_nothing_is_left(rows):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert found(c.repair(c.damage(rows([(gone, 0, "user", "x.")])))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_texts_clashing_names_and_empty_table(rows, clashes):
    data = [(1, 0, "user", "long text. " * 200_000), (1, 1, "assistant", "x" * 1_500_000 + "."), (1, 2, "user", "end")]
    df = rows(data).select("*", *[F.lit(1).alias(x) for x in (*clashes, "block", "code", "times", "said", "place", "first", "kind")])
    columns = ["conv_id", "turn", "role", "text"]
    assert found(c.repair(c.damage(df.select(*columns, "n", "block", "said")))) == expected(data)
    assert c.repair(c.damage(rows([]))).count() == 0


def test_one_long_conversation_is_spread_over_tasks(spark, rows):
    data = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(6000)]
    cut = c.blocks(rows(data).withColumn("times", F.lit(1).cast("bigint")))
    sizes = [r[0] for r in cut.select(F.size("code")).collect()]
    assert sum(sizes) == 6000 and max(sizes) <= c.ROWS and len(sizes) >= 6


def test_ranks_pick_the_least_path():
    import numpy as np

    arcs, target = np.zeros((6, 4), bool), np.tile(np.arange(6)[:, None], (1, 4))
    for v, letter, w in ((0, 2, 1), (0, 3, 2), (1, 1, 3), (1, 0, 4), (2, 0, 5), (3, 0, 5), (4, 3, 5)):
        arcs[v, letter], target[v, letter] = True, w
    letter, pointers = c.ranked(arcs, target)
    assert letter.tolist() == [2, 0, 0, 0, 3, -1]
    assert pointers[0].tolist() == [1, 4, 5, 5, 5, 5] and pointers[-1][0] == 5
