"""Entity resolution against a plain single-process restatement."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from gigmesh.functions import fuzzy
from gigmesh.operators import cluster, resolve
from gigmesh.schema import with_id
from gigmesh.plans.processed import processed

RAW = """seq bigint, date timestamp_ntz, venue_id string, venue_name string, venue_location string, bands array<string>,
  age_requirement string, price_advance int, price_door int, time string, flags array<string>, source string,
  source_url string, genre_tags array<string>"""
FIELDS = [f.split()[0] for f in RAW.replace("\n", " ").split(", ")]


# -- restatement -----------------------------------------------------------------


def key(s):
    s = re.sub(r"^the\s+", "", s.lower().strip())
    s = re.sub(r",\s*the$", "", s)
    s = re.sub(r"\s*[-–]\s*(boston|cambridge|somerville|brookline|allston|brighton).*$", "", s)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", s)).strip()


def minutes(t):
    m = re.match(r"(\d+)(?::(\d+))?\s*(am|pm)?", t.lower().strip())
    if not m:
        return -1
    h = int(m[1])
    h = h + 12 if m[3] == "pm" and h != 12 else 0 if m[3] == "am" and h == 12 else h
    return h * 60 + int(m[2] or 0)


def near(a, b):
    x, y = minutes(a), minutes(b)
    return a.lower() == b.lower() if x < 0 or y < 0 else abs(x - y) <= 60


def same_show(a, b):
    va, vb = key(a["venue_name"] or a["venue_id"]), key(b["venue_name"] or b["venue_id"])
    if fuzzy.ratio_of(va, vb) < 80 and not (a["venue_id"] and a["venue_id"].lower() == (b["venue_id"] or "").lower()):
        return False
    ha, hb = key(a["bands"][0]), key(b["bands"][0])
    if fuzzy.ratio_of(ha, hb) >= 80 or fuzzy.partial_of(ha, hb) >= 95 or fuzzy.token_set_of(ha, hb) >= 95:
        return not (a["time"] and b["time"] and not near(a["time"], b["time"]))
    votes = []
    if a["time"] and b["time"]:
        votes.append(near(a["time"], b["time"]))
    for p in ("price_advance", "price_door"):
        if a[p] is not None or b[p] is not None:
            votes.append(a[p] == b[p])
    if a["age_requirement"] and b["age_requirement"]:
        votes.append(a["age_requirement"] == b["age_requirement"])
    if len(a["bands"]) > 1 and len(b["bands"]) > 1:
        votes.append(any(fuzzy.ratio_of(key(x), key(y)) >= 80 for x in a["bands"][1:] for y in b["bands"][1:]))
    return len(votes) >= 3 and sum(votes) >= len(votes) // 2 + 1


def groups_of(rows):
    out, taken = [], set()
    for i, a in enumerate(rows):
        if i in taken:
            continue
        group = [a]
        for j in range(i + 1, len(rows)):
            if j not in taken and rows[j]["date"].date() == a["date"].date() and same_show(a, rows[j]):
                group.append(rows[j])
                taken.add(j)
        out.append(group)
    return out


def score(r):
    head = r["bands"][0]
    return (
        len(head) // 10 + (5 if ":" in head or "-" in head or "tour" in head.lower() else 0) + 2 * len(r["bands"])
        + 3 * (r["price_advance"] is not None) + 3 * (r["price_door"] is not None) + 4 * len(r["flags"])
        + 2 * (r["age_requirement"] not in ("", "a/a")) + 2 * (r["time"] not in ("", "8pm")) + len(r["genre_tags"])
        + 2 * bool(r["source_url"])
    )


RANK = {"ticketmaster": 1, "scrape:safe_in_a_crowd": 2, "scrape:middle_east": 3, "scrape:do617": 4}


def own_site(s):
    return "ticketmaster" not in s and "seatgeek" not in s and s not in ("", "unknown")


def merged(group):
    leader = group[0]["seq"]
    if len(group) == 1:
        return dict(group[0])
    order = sorted(group, key=lambda r: (-score(r), RANK.get(r["source"], 99)))
    best = dict(order[0])
    for r in order[1:]:
        best["bands"] = resolve.add_bands(best["bands"], r["bands"])[0]
        for p in ("price_advance", "price_door"):
            best[p] = r[p] if not best[p] and r[p] else best[p]
        best["flags"] = sorted(set(best["flags"]) | set(r["flags"]))
        best["genre_tags"] = sorted(set(best["genre_tags"]) | set(r["genre_tags"]))
        if best["time"] == "8pm" and r["time"] != "8pm":
            best["time"] = r["time"]
        if best["age_requirement"] == "a/a" and r["age_requirement"] != "a/a":
            best["age_requirement"] = r["age_requirement"]
        if r["source_url"] and own_site(r["source"]) and (not best["source_url"] or not own_site(best["source"])):
            best["source_url"] = r["source_url"]
    sources = {r["source"] for r in group}
    if len(sources) > 1:
        best["source"] = "merged:" + "+".join(sorted(sources))
    return {**best, "seq": leader}


# -- data -------------------------------------------------------------------------------


def dirty(n, seed, days=3, long_names=False, **fixed):
    rng = random.Random(seed)
    venues = [
        ("paradise", "Paradise Rock Club"), ("paradise_rock", "The Paradise Rock Club - Boston"), ("sinclair", "The Sinclair"),
        ("SINCLAIR", "Sinclair"), ("x1", "Lizard Lounge"), ("x1", "Completely Different"), ("deep", ""), ("q", "!!!"),
    ]
    acts = ["Converge", "Convergence", "The Pile", "Pile", "Krill", "Club d'Elf", "Club d'Elf ft. Duke Levine", "Bane: Last Tour", "Bane"]
    if long_names:
        acts += [
            "Kenny Wayne Shepherd Band Live In Concert", "Kenny Wayne Shepherd Band Live In Concert Again",
            "Kenny Wayne Shepherd Band Live In Concerts", "Kenny Wayne Shepherds Band Live In Concert Agains!!",
        ]
    rows = []
    for i in range(n):
        vid, vname = rng.choice(venues)
        row = dict(
            seq=i * 3 + 1, date=dt.datetime(2026, 1, 1 + rng.randrange(days)), venue_id=vid, venue_name=vname, venue_location="Boston",
            bands=[rng.choice(acts) for _ in range(rng.choice([1, 1, 2, 3]))], age_requirement=rng.choice(["a/a", "21+", "18+"]),
            price_advance=rng.choice([None, 0, 10, 15]), price_door=rng.choice([None, None, 15]), time=rng.choice(["8pm", "7pm", "10pm", "late"]),
            flags=rng.choice([[], ["$"], ["@"]]), source=rng.choice(["ticketmaster", "seatgeek", "scrape:do617", "club"]),
            source_url=rng.choice([None, "", f"https://x/{i}"]), genre_tags=rng.choice([[], ["punk"], ["ska", "punk"]]),
        )
        rows.append({**row, **fixed})
    return rows


def frame(spark, rows):
    return with_id(spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], RAW)).select(*FIELDS, "id")


def check(spark, rows, size):
    got = {r["seq"]: r.asDict() for r in resolve.deduplicate(frame(spark, rows), size).collect()}
    want = {g["seq"]: g for g in map(merged, groups_of(rows))}
    assert set(got) == set(want)
    for seq, w in want.items():
        g = got[seq]
        for f in FIELDS:
            assert g[f] == w[f], (seq, f, g[f], w[f])


@pytest.mark.parametrize("seed, n, size", [(1, 60, 64), (2, 150, 64), (3, 120, 4)])
def test_matches_restatement(spark, seed, n, size):
    check(spark, dirty(n, seed), size)


def test_one_hot_night(spark):
    """One venue and day hold everything: settled in rounds, most rows are near-copies."""
    rows = dirty(150, 7, days=1, venue_id="paradise", venue_name="Paradise")
    check(spark, rows, 3)


def test_many_copies_collapse(spark):
    base = dirty(5, 9, days=1)
    rows = [{**base[i % 5], "seq": i, "source": f"s{i % 7}"} for i in range(300)]
    check(spark, rows, 2)


@pytest.mark.parametrize("size", [1, 64])
def test_long_names_replace_in_order(spark, size):
    rows = dirty(80, 11, days=1, long_names=True, venue_id="p", venue_name="P", time="8pm", age_requirement="a/a", price_advance=10)
    check(spark, rows, size)


def test_copies_are_idempotent(spark):
    rows = dirty(30, 13)
    once = resolve.deduplicate(frame(spark, rows))
    assert once.count() <= len(rows)
    assert {r.id for r in once.select("id").collect()} <= {r.id for r in frame(spark, rows).collect()}


@pytest.mark.parametrize("seed, size", [(1, 2), (2, 5), (3, 64)])
def test_leaders_equal_greedy_loop_on_random_graphs(spark, seed, size):
    rng = random.Random(seed)
    nodes = [(f"b{b}", p) for b in range(4) for p in rng.sample(range(1000), rng.choice([1, 12, 30]))]
    edge = {(b, *sorted(pq)) for b, p in nodes for c, q in nodes for pq in [(p, q)] if b == c and p < q and rng.random() < 0.15}
    df = spark.createDataFrame(nodes, "block string, pos bigint")
    edges = spark.createDataFrame(sorted(edge), "eb string, p bigint, q bigint")

    def matches(pairs):
        return pairs.join(edges, (F.col("a.block") == F.col("eb")) & (F.col("a.pos") == F.col("p")) & (F.col("b.pos") == F.col("q")))

    got = {(r.block, r.pos): r.leader for r in cluster.leaders(df, matches, size).distinct().collect()}
    want = {}
    for b in {n[0] for n in nodes}:
        heads = []
        for p in sorted(n[1] for n in nodes if n[0] == b):
            lead = next((h for h in heads if (b, h, p) in edge), None)
            if lead is None:
                heads.append(p)
            else:
                want[(b, p)] = lead
                want[(b, lead)] = lead
    assert got == want


def test_not_transitive(spark):
    rows = dirty(3, 1, days=1, venue_id="v", venue_name="V", age_requirement="", price_advance=None, price_door=None)
    for r, t in zip(rows, ("7pm", "8pm", "9pm")):
        r.update(bands=["Pile"], time=t)
    got = {(r.seq, r.leader) for r in resolve.clusters(frame(spark, rows)).collect()}
    assert got == {(1, 1), (4, 1)}


def test_processing_order_does_not_matter_for_past_rows(spark):
    rows = dirty(80, 21, days=4)
    got = {r.seq for r in processed(frame(spark, rows), "2026-01-03").select("seq").collect()}
    assert got and all(next(r for r in rows if r["seq"] == s)["date"] >= dt.datetime(2026, 1, 3) for s in got)


def test_plan_has_no_cartesian_product(spark):
    df = frame(spark, dirty(10, 3))
    plan = resolve.merge_fields(df.withColumn("leader", F.col("seq")))._jdf.queryExecution().toString()
    assert "partial_min" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("seed, batch, copies, kept", [(1, 7, 1 << 16, 1 << 26), (2, 10_000, 3, 40), (4, 1, 1, 0)])
def test_sorted_pass_equals_pairs_in_rounds(spark, monkeypatch, seed, batch, copies, kept):
    """Leaders by one pass, in batches that cut blocks, against the same test stated on pairs."""
    from gigmesh.operators import elect

    rows = dirty(160, seed, days=2)
    for r, t in zip(rows[::3], ["", "late", "7pm", "8:30pm"] * 40):
        r["time"] = t
    df = frame(spark, rows)
    groups = resolve.venue_groups(resolve.features(df))
    nodes = resolve.features(df).join(groups, "vkey").withColumn("block", F.concat_ws("|", "day", "venue_group")).withColumn("pos", F.col("seq"))
    want = {(r.pos, r.leader) for r in cluster.leaders(nodes, resolve.duplicates, 64).collect()}
    monkeypatch.setattr(elect, "COPIES", copies)
    monkeypatch.setattr(elect, "KEPT", kept)
    table = nodes.select("seq", "block", *elect.FIELDS).orderBy("block", "seq").toArrow()
    found = list(elect.with_leaders(iter(table.to_batches(batch)), ["seq"], ["block"], elect.FIELDS))
    got = [(r["seq"], r["leader"]) for b in found for r in b.to_pylist()]
    assert sorted(s for s, _ in got) == sorted(r["seq"] for r in rows)
    assert {(s, leader) for s, leader in got if leader is not None} == want


def test_listings_move_once_and_pairs_are_never_formed(spark):
    rows = frame(spark, dirty(20, 3))
    plan = resolve.elected(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "ArrowEvalPython" not in plan and "SortMergeJoin" not in plan


def test_shuffle_files_go_when_their_table_is_written(spark):
    import os

    from gigmesh.runtime import CLEANUP, cut_lineage

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def held():
        return {f for top in folders for r, _, names in os.walk(top) for f in names if f.endswith(".data")}

    before = held()
    table = cut_lineage(spark.range(1000).repartition(3, "id"))
    assert not held() - before and spark.conf.get(CLEANUP) == "false"
    assert table.count() == 1000
