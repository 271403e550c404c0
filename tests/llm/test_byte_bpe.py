import hashlib
import random

import pytest
import regex
import tiktoken

from gigmesh.llm import byte_bpe as b

HARD = (
    ["a" * k for k in (1, 2, 3, 7, 50)] + ["ab" * 40, "*" * 200, "the" * 300, "x\u00a0\u2003y\x85z\x1c\x1d", " \n\n  a", "  ", "don't I'LL we're", "日本語のテキスト" * 20]
    + ["e\u0301\u200d👍🏽", "½²①", "\x00\x01", "'s's'"]
)


@pytest.fixture(scope="module")
def tokenizer():
    with open(b.VOCABULARY, "rb") as f:
        return tiktoken.Encoding("own", pat_str=b.PATTERN, mergeable_ranks=b.read_ranks(f.read()), special_tokens={})


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    alphabet = "abcdefghij \n\t.,!0123456789éßñ日本語'ſ"
    return HARD + ["".join(r.choices(alphabet, k=r.randint(0, 80))) for _ in range(300)] + ["".join(r.choices("abcdefgh", k=3000))]


def test_pieces_match_the_reference_tokenizer(tokenizer, texts):
    with open(b.VOCABULARY, "rb") as f:
        tables = b.Tables(f.read())
    split = regex.compile(b.PATTERN)
    pieces = [split.findall(t) for t in texts]
    assert ["".join(p) for p in pieces] == texts
    fresh = list({p for own in pieces for p in own})
    known = dict(zip(fresh, tables.encode_pieces([p.encode() for p in fresh]), strict=True))
    for text, own in zip(texts, pieces, strict=True):
        assert [int(i) for p in own for i in known[p]] == tokenizer.encode_ordinary(text), text[:60]


def test_round_trip_and_digests(table, tokenizer, texts, clashes):
    rows = list(enumerate(texts[:60])) + [(900, None), (901, ""), (0, texts[0]), (None, "no id")]
    docs = table(rows, **clashes)
    assert {(r.doc_id, tuple(r.ids), r.decoded.decode()) for r in b.decode(b.encode(docs)).collect()} == {
        (d, tuple(tokenizer.encode_ordinary(t or "")), t or "") for d, t in rows
    }
    out = b.digests(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        text = "no id" if r.doc_id is None else dict(rows)[r.doc_id] or ""
        ids = tokenizer.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        )


def test_what_a_task_remembers_may_start_over(table, tokenizer, texts, monkeypatch):
    monkeypatch.setattr(b, "REMEMBERED", 500)
    monkeypatch.setattr(b, "WORTH", 4)
    monkeypatch.setattr(b, "SLICE_BYTES", 100)
    rows = list(enumerate(texts[:40]))
    assert {r.doc_id: list(r.ids) for r in b.encode(table(rows)).collect()} == {d: tokenizer.encode_ordinary(t) for d, t in rows}


def test_empty_table(table):
    assert b.digests(table([])).count() == 0


def test_longer_pieces_and_more_of_them_than_a_query_holds(tokenizer, texts, monkeypatch):
    monkeypatch.setattr(b, "PLACE_BITS", 3)
    monkeypatch.setattr(b, "PIECES", 7)
    monkeypatch.setattr(b, "LONG", 12)
    with open(b.VOCABULARY, "rb") as f:
        tables = b.Tables(f.read())
    split = regex.compile(b.PATTERN)
    pieces = sorted({p for t in texts[:120] for p in split.findall(t)})
    for piece, ids in zip(pieces, tables.encode_pieces([p.encode() for p in pieces]), strict=True):
        assert ids.tolist() == tokenizer.encode_ordinary(piece)


def test_very_long_text_of_one_piece(table, tokenizer):
    text = "ab" * 60_000
    (r,) = b.digests(table([(1, text)])).collect()
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.n_tokens == len(b.encode(table([(1, text)])).first().ids)


def test_one_python_step(table):
    plan = b.digests(table([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
