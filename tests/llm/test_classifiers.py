import tempfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from gigmesh.llm import compression_classifier as c
from gigmesh.llm import language_id as g

from .conftest import SF_DIR


def test_language_held_out_accuracy(spark):
    out = g.query(spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out and r.lang is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark, table, clashes):
    rows = [("en", "the cat and the dog and the bird"), ("de", "der hund und die katze und der vogel")] * 5
    labelled = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id bigint, lang string, text string")
    model = g.fit(labelled)
    docs = table([(1, None), (2, ""), (3, "123 !? ²"), (4, "The DOG"), (5, "katzen"), (6, "привет"), (4, "The DOG"), (None, "und die")], **clashes)
    out = g.predict(docs, model, "doc_id").collect()
    named = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert len(out) == 8 and named[1] == named[2] == named[3] == ("und", 0.0)
    assert (named[4][0], named[5][0], named[None][0]) == ("en", "de", "de") and named[6][0] in ("de", "en")
    nothing = g.fit(labelled.limit(0))
    assert {r.lang_pred for r in g.predict(docs, nothing, "doc_id").collect()} == {"und"}
    assert g.predict(table([]), model, "doc_id").count() == 0


def test_language_backs_off_to_shorter_grams():
    model = g.Model([("a", "banana banana"), ("b", "quiz quiz")], {"a": 0.5, "b": 0.5})
    assert "banana" in model.keys[0] and "bananas" not in model.keys[0]
    word, by_long, by_letter, none = model.word_scores(["banana", "bananas", "zu", "\u0436"])
    assert word[0] > 0 > word[1] and by_long[0] > 0 and by_letter[1] > 0
    assert "zu" not in model.keys[2] and by_letter[-1] == 1
    # Of a word nobody knows, the spaces around it may still be known as single letters.
    assert none[-1] in (0, 1)
    mean = np.mean([model.logs[4][model.keys[4][x]] for x in g.grams("bananas", 4) if x in model.keys[4]], axis=0)
    assert np.allclose(by_long[:-1], mean, atol=1e-6)


def test_language_memory_may_start_over(table, monkeypatch):
    model = g.Model([("a", "ana nana bana"), ("b", "quiz quit quick")] * 3, {"a": 0.5, "b": 0.5})
    docs = table([(k, ["ana banana", "quit the quiz"][k % 2]) for k in range(40)])
    want = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in g.predict(docs, model, "doc_id").collect()}
    monkeypatch.setattr(g, "REMEMBERED", 1)
    monkeypatch.setattr(g.tb, "SLICE_BYTES", 30)
    assert {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in g.predict(docs, model, "doc_id").collect()} == want
    assert {n for _, n, _ in want} == {"a", "b"}


def test_every_label_is_learned(spark, invent, monkeypatch):
    texts = {f"l{k:03}": " ".join(invent(2, 500 + k) * 3 + [f"{chr(0x4E00 + k)}{chr(0x5000 + k)}"] * 4) for k in range(100)}
    rows = [(k * 3 + n, lang, text) for k, (lang, text) in enumerate(texts.items()) for n in range(1 + (k < 64))]
    labelled = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = g.fit(labelled)
    assert model.languages == sorted(texts)
    monkeypatch.setattr(g, "SAMPLE_CHARS", 1)  # one text of each is left
    out = g.predict(labelled, g.fit(labelled), "lang").collect()
    assert len(out) == len(rows) and all(r.lang == r.lang_pred for r in out)
    assert g.sample_chars(64) == g.sample_chars(1) and g.sample_chars(128) * 128**2 <= g.SAMPLE_CHARS * 64**2 + 128**2


def test_language_sample_shuffles_no_text_beyond_it(spark, monkeypatch):
    monkeypatch.setattr(g, "SAMPLE_CHARS", 200)
    seen = []
    monkeypatch.setattr(g, "Model", lambda texts, shares: seen.extend(texts))
    frames = []
    monkeypatch.setattr(type(spark.range(0)), "toLocalIterator", lambda df, *a, **b: frames.append(df) or iter(df.collect()))
    labelled = spark.range(4000).selectExpr("id doc_id", "if(id % 4 = 0, 'de', 'en') lang", "concat('some words ', id) text")
    path = f"{tempfile.mkdtemp(prefix='spark-')}/labelled"
    labelled.write.parquet(path)
    g.fit(spark.read.parquet(path))
    assert 0 < sum(len(r[1]) for r in seen) < 500
    plan = frames[0]._jdf.queryExecution().executedPlan()
    assert "SortMergeJoin" not in plan.toString() and "BroadcastHashJoin" in plan.toString()
    moved = [int(x.replace(",", "")) for x in _shuffled(plan)]
    assert moved and max(moved) < 200


def _shuffled(node):
    """Rows that exchanges of an executed plan wrote."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _shuffled(node.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _shuffled(node.plan())
    else:
        if name == "ShuffleExchangeExec":
            yield str(node.metrics().apply("shuffleRecordsWritten").value())
        below = node.children()
        for k in range(below.size()):
            yield from _shuffled(below.apply(k))


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(g, "SAMPLE_CHARS", 50)
    rows = [(k, "en", "alpha beta gamma") for k in range(500)]
    model = g.fit(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    assert model.languages == ["en"]


def test_quality_held_out(spark):
    out = c.query(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = out.join(labels, "doc_id").where("held_out").collect()
    right = {q: [r for r in held if r.quality == q] for q in (0, 1)}
    assert sum(r.predicted for r in right[1]) >= 0.95 * len(right[1])
    assert sum(r.predicted for r in right[0]) <= 0.3 * len(right[0])
    every = out.collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in every)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in every)


def test_quality_edges(spark, table, invent, clashes):
    rows = [(k, " ".join(invent(80, k)), 1) for k in range(12)] + [(20 + k, "&&& ".join(invent(80, k)).upper(), 0) for k in range(12)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = c.fit(labelled, {0: 12, 1: 12})
    docs = table([(1, None), (2, ""), (3, " ".join(invent(90, 77))), (4, "&&& ".join(invent(90, 78)).upper()), (None, "a")], **clashes)
    out = {r.doc_id: r.score for r in c.score(docs, model, "doc_id").collect()}
    assert len(out) == 5 and out[3] > 0.5 > out[4] and out[1] == out[2]
    alone = c.fit(labelled.where("quality = 1"), {1: 12})
    assert all(r.score > 0.9 for r in c.score(docs, alone, "doc_id").collect())
    blank = c.fit(labelled.limit(0), {})
    assert all(r.score == 0.5 for r in c.score(docs, blank, "doc_id").collect())
    assert c.score(table([]), model, "doc_id").count() == 0
    one = c.fit(labelled.where(F.col("doc_id").isin(1, 21)), {0: 1, 1: 1})
    assert c.score(docs, one, "doc_id").count() == 5
