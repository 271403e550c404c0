import random
from collections import defaultdict

from gigmesh.llm import chat_format as c

POOL = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "\n", "n", "a b", "<", "]", "é", "$1", "", " ", "\n</s>\n", "\n[INST]\n", "\\n", "\r", "\u2028"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def invented():
    r = random.Random(3)
    rows = []
    for conv in range(40):
        for k in range(r.choice([1, 2, 5, 130])):
            role = r.choice(["user", "assistant", "system", "a\nb", "x\\n", "\\\nn", None]) if k else r.choice(["system", "user"])
            text = "".join(r.choice(POOL) for _ in range(r.randint(0, 12))) + " w" * r.choice([0, 3, 50, 700]) if r.random() < 0.9 else None
            rows.append((conv, k if r.random() < 0.95 else k - 1, role, text))
    return rows + [(99, 0, "assistant", "same")] * 5 + [(None, 1, "user", "x"), (None, None, "assistant", "y"), (98, -3, "user", "early"), (98, 4, None, None)]


def by_conversation(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn if turn is not None else -1e18, role or "", text or ""))
    return {conv: [(role, text) for _, role, text in sorted(v)] for conv, v in out.items()}


def test_every_turn_and_target_comes_back_once(spark):
    rows = invented()
    back = c.read_back(c.windows(spark.createDataFrame(rows, SCHEMA).repartition(4))).collect()
    turns, targets = defaultdict(list), defaultdict(list)
    for r in sorted(back, key=lambda r: (r.conv_id or 0, r.block, r.window)):
        turns[r.conv_id] += [(t.role, t.text) for t in r.turns]
        targets[r.conv_id] += r.targets
    want = by_conversation(rows)
    assert dict(turns) == want
    assert {k: v for k, v in targets.items() if v} == {k: t for k, v in want.items() if (t := [x for role, x in v if role == "assistant"])}


def test_windows_keep_to_the_budget(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, ["user", "assistant"][k % 2], f"t{k} " + "w " * 40) for k in range(1, 200)]
    out = c.windows(spark.createDataFrame(rows, SCHEMA)).orderBy("block", "window").collect()
    assert len(out) > 10
    for k, r in enumerate(out):
        turns = r.formatted.split("\n</s>\n")[:-1]
        tokens = sum(len(t.split("\n[INST]\n", 1)[1].split()) + c.TURN_COST for t in turns)
        assert tokens <= c.BUDGET
        assert turns[0] == "<s>system\n[INST]\nbe kind"
        assert r.n_context == (0 if k == 0 else 3)  # the system turn and two turns of history
        assert [r.formatted[s.start - 1 : s.start - 1 + s.length][:2] for s in r.loss] == [
            t.split("\n[INST]\n", 1)[1][:2] for t in turns[r.n_context :] if t.startswith("<s>assistant")
        ]


def test_escapes():
    assert c.BLOCK > c.HISTORY_TURNS


def test_query_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    out = c.query(spark, str(tmp_path)).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in out] == [(-7, 2, len("</s>[INST] ok [/INST]"))]


def test_no_python_in_the_plan(spark):
    plan = c.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
