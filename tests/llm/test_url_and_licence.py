import numpy as np

from gigmesh.llm import licence_scan as s
from gigmesh.llm import url_filter as u

PAGES = [
    (1, "http://a.com/x", '<link rel="canonical" href="https://b.net/y?q=1#z">', None, "block"),
    (2, "http://c.org/fr/1", '<meta http-equiv="refresh" content="0; url=http://a.com/x">', "org/fr/", "allow"),
    (3, "http://c.org/de/1", '<meta http-equiv="refresh" content="0; url=/fr/1">', None, "block"),
    (4, None, "<p>", None, "allow"),
    (5, "nohost", None, None, "allow"),
    (6, "http://D.example.net/en/a", "", "example.net/en/", "allow"),
    (7, "http://net/", None, "net/", "block"),
    (8, "http://xnet/", None, None, "allow"),
    (9, "http://q.com/a/b", "<LINK href='c' rel=canonical>", None, "allow"),
    (10, "https://q.com/a/c#f", None, None, "allow"),
    (11, "http://q.net?x=/", None, None, "allow"),
    (12, "http://a.com/x", None, None, "block"),
    (None, "ftp://a.com/x#part", None, None, "block"),
    (13, "http://w.example.com/de/p", None, "example.com/de/", "block"),
    (14, "http://a.com/x?other", None, None, "allow"),
]


def test_verdicts_spread_over_aliases(spark):
    pages = spark.createDataFrame([p[:3] for p in PAGES], "page_id bigint, url string, html string").selectExpr("*", "1 node", "'h' host", "2 component")
    out = {r.page_id: (r.rule, r.verdict) for r in u.judge(pages, u.rules_table(spark)).collect()}
    assert out == {p[0]: p[3:] for p in PAGES}
    assert u.judge(pages.limit(0), u.rules_table(spark)).count() == 0


def test_host_and_path(spark, evaluate):
    urls = ["http://A.B/c?d", "x://H#f/g", "://e/p/q#r", "no", None, "http://É.com?a/b", "a://b://c/d"]
    assert evaluate(u.host_of, urls) == ["a.b", "h", "e", "", "", "É.com", "b:"]
    assert evaluate(u.path_of, urls) == ["/c", "", "/p/q", "", "", "", "//c/d"]


def test_long_chain_and_hub(spark):
    chain = [(k, f"http://s{k}.com/", f'<link rel="canonical" href="http://s{k + 1}.com/">') for k in range(30)] + [(30, "http://s30.com/", '<link rel="canonical" href="http://bad.net/">')]
    hub = [(100 + k, f"http://h{k}.com/", '<link rel="canonical" href="http://hub.org/">') for k in range(200)]
    out = u.judge(spark.createDataFrame(chain + hub, "page_id bigint, url string, html string"), u.rules_table(spark)).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == set(range(31))


def grams(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return set(zip(w, w[1:], strict=False))


def test_pruning_loses_no_template(invent):
    known = s.Templates(s.TEMPLATES)
    for k, (_, text) in enumerate(s.TEMPLATES):
        w = text.split()
        for cut in (0, 1, len(w) // 8, len(w) // 4):
            body = " ".join(w[cut:] + invent(cut // 2, k))
            raw = np.frombuffer(body.encode(), np.uint8)
            got = known.best(s.bigrams(s._words(raw, np.array([0, len(raw)]))[3]))
            scores = [2 * len(grams(body) & grams(t)) / max(1, len(grams(body)) + len(grams(t))) for _, t in s.TEMPLATES]
            assert (got is None) == (max(scores) < s.LEAST) and (got is None or abs(got[0] - max(scores)) < 1e-12)


def test_scan_edges(table, clashes):
    mit = s.TEMPLATES[4][1]
    rows = [(1, None), (2, ""), (3, "one"), (4, "x y z\nReleased under the MIT License!\n\nmore words here"), (5, mit), (6, mit.replace("copy, modify", "copy,\nmodify")), (None, "All rights reserved.")]
    out = {r.doc_id: r.matches for r in s.scan(table(rows + [rows[3]], **clashes)).collect()}
    assert [out[k] for k in (1, 2, 3)] == [[], [], []]
    assert [m.licence for m in out[4]] == ["MIT"] and rows[3][1][out[4][0].begin : out[4][0].finish] == "Released under the MIT License!"
    assert {m.licence for m in out[5]} >= {"MIT"} and max(m.score for m in out[5]) == 1.0
    assert max(m.score for m in out[6]) == 1.0 and out[None][0].licence == "Proprietary"
    assert s.scan(table([])).count() == 0


def full(licence):
    return max((t for name, t in s.TEMPLATES if name == licence), key=len)


def wrapped(text, *breaks):
    """Lines of twelve words; an empty line before each of ``breaks``."""
    text = " ".join(text.split())
    for b in breaks:
        assert b in text
        text = text.replace(b, "\n\n" + b)
    return "\n\n".join("\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12)) for w in (p.split() for p in text.split("\n\n")))


def test_whole_licences_inside_longer_texts(table, invent):
    gpl = next(t for name, t in s.TEMPLATES if name == "GPL-3.0" and t.startswith("This program"))
    bodies = {
        "BSD-2-Clause": wrapped(full("BSD-2-Clause"), "1. Redis", "2. Redis", "THIS SOFTWARE IS"),
        "BSD-3-Clause": wrapped(full("BSD-3-Clause"), "1. Redis", "2. Redis", "3. Neither", "THIS SOFTWARE IS"),
        "MIT": wrapped(s.TEMPLATES[4][1], "The above copyright", "THE SOFTWARE IS"),
        "GPL-3.0": wrapped(gpl, "This program is distributed", "You should have"),
        "Unlicense": wrapped(full("Unlicense"), "In jurisdictions", "THE SOFTWARE IS"),
        "Apache-2.0": wrapped(full("Apache-2.0"), "TERMS AND"),
        "GPL-2.0": wrapped(full("GPL-2.0"), "Preamble", "NO WARRANTY"),
        "MPL-2.0": wrapped(full("MPL-2.0"), "2. License Grants", "3. Responsibilities"),
        "LGPL-3.0": wrapped(full("LGPL-3.0"), "1. Exception", "3. Object Code", "5. Combined"),
    }
    rows = []
    for k, body in enumerate(bodies.values()):
        head, tail = (wrapped(" ".join(invent(400, 50 * n + k))) for n in (1, 2))
        rows.append((k, f"{head}\n\n{body}\n\n{tail}"))
    twice = bodies["MIT"] + "\n\n" + bodies["MIT"]
    rows.append((99, f"some words\n\n{twice}\n\n{wrapped(' '.join(invent(900, 5)))}"))
    out = {r.doc_id: r.matches for r in s.scan(table(rows)).collect()}
    for k, (licence, body) in enumerate(bodies.items()):
        best = max(out[k], key=lambda m: m.finish - m.begin)
        at = rows[k][1].index(body)
        assert best.licence == licence and best.score >= s.LEAST, (licence, out[k])
        assert min(best.finish, at + len(body)) - max(best.begin, at) > 0.8 * len(body)
        if len(body) < 3000:  # no line, paragraph or whole text is close to these
            assert best.score > 0.98 and at <= best.begin and best.finish <= at + len(body)
    assert [m.licence for m in out[99]] == ["MIT", "MIT"]


def test_windows_are_the_best_runs_of_lines(invent):
    licence = "one two three four five six seven eight nine ten"
    known = s.Templates([("L", licence)])
    for seed in range(40):
        words = invent(6, seed) + licence.split() + invent(6, seed + 100) + licence.split()[seed % 5 :]
        cuts = [k for k in range(1, len(words)) if (k * 7 + seed) % 3 == 0]
        lines = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True)]
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        bounds = np.array([0, *cuts, len(words)])
        got = s._windows(known, s._words(raw, np.array([0, len(raw)]))[3], bounds[:-1], bounds[1:])
        runs = {}
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                mine, t = grams(" ".join(sum(lines[i : j + 1], []))), grams(licence)
                runs[i, j] = 2 * len(mine & t) / (len(mine) + len(t))
        assert got and max(x[1] for x in got) == max(runs.values())
        assert all(abs(runs[i, j] - score) < 1e-12 for _, score, _, i, j in got)
