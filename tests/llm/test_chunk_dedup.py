import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gigmesh.llm import chunk_dedup as c


@given(st.text(max_size=400))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text_between_characters(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    bounds = c.cuts(raw)
    assert bounds[0] == 0 and bounds[-1] == len(raw) and (np.diff(bounds) > 0).all()
    assert "".join(raw[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:], strict=False)) == text


def test_gear_is_the_rolling_sum():
    raw = np.frombuffer(b"some bytes to roll over, more than sixteen", np.uint8)
    h, want = 0, []
    for b in raw:
        h = ((h << 1) + int(c._GEAR[b])) & 0xFFFF
        want.append(h)
    assert c.gear(raw).tolist() == want


def test_cuts_fall_into_step_after_an_insertion(invent):
    text = " ".join(invent(2000, 1)).encode()
    other = b"inserted words " + text[:3000] + b" and more " + text[3000:]

    def pieces(t):
        raw = np.frombuffer(t, np.uint8)
        b = c.cuts(raw)
        return {t[x:y] for x, y in zip(b, b[1:], strict=False)}

    assert len(pieces(text) - pieces(other)) <= 8
    assert max(map(len, pieces(b"x" * 5000))) <= c.MOST


def left(df):
    return {r.doc_id: r.text for r in c.remove_spans(df, c.repeated_spans(df)).collect()}


def test_passages_go_and_first_copies_stay(table, invent, clashes):
    passage = " ".join(invent(60, 7))
    rows = [(k, " ".join(invent(80, 10 + k)) + " " + passage + "\n" + " ".join(invent(50 + k, 60 + k))) for k in range(12)]
    clean = [(100 + k, " ".join(invent(150, 200 + k))) for k in range(20)]
    whole = [(50, clean[0][1])]
    df = table(rows + clean + [(50, whole[0][1]), (None, None), (7000, "")], **clashes).repartition(5)
    out = left(df)
    words = passage.split()
    for k in range(1, 12):
        assert words[25:30] != [] and " ".join(words[20:40]) not in out[k]
        assert out[k].startswith(" ".join(invent(80, 10 + k)))
    assert out[0] == rows[0][1]
    # 50 comes before 100, so the copy in 100 goes.
    assert out[50] == clean[0][1] and len(out[100]) < 40
    assert all(out[d] == t for d, t in clean[1:])
    found = {r.doc_id for r in c.repeated_spans(df).collect()}
    assert found == set(range(1, 12)) | {100}


def test_repeats_inside_a_text_and_repeated_rows(table, invent):
    part = " ".join(invent(70, 3))
    df = table([(1, part + "\n" + part + "\n" + part), (1, part + "\n" + part + "\n" + part), (2, "other words here")])
    out = c.remove_spans(df, c.repeated_spans(df)).collect()
    assert len(out) == 3
    texts = {r.text for r in out if r.doc_id == 1}
    assert len(texts) == 1 and len(texts.pop()) < len(part) + 160


def test_empty_table(table):
    assert c.repeated_spans(table([])).count() == 0


def test_stage_keeps_columns_and_drops_empty_texts(spark, invent):
    part = " ".join(invent(90, 4))
    rows = [(1, part, "en", "s", len(part)), (2, part, "en", "s", len(part)), (3, "x", None, None, 1), (4, None, "en", "s", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r.doc_id: r for r in c.stage(spark, df, "").collect()}
    assert out.keys() == {1, 3} or (out.keys() == {1, 2, 3} and out[2].n_chars < 60)
    assert out[1].text == part and all(r.n_chars == len(r.text) for r in out.values())
