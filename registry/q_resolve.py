"""Similarity, duplicate pairs, clusters and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from gigmesh.functions import fuzzy
from gigmesh.operators import resolve
from gigmesh.operators.normalize import normalize_listings
from gigmesh.operators.similar import similar_pairs
from gigmesh.plans.processed import processed
from gigmesh.runtime import cut_lineage
from gigmesh.sources.tables import AS_OF, listings, table
from registry.base import NORM, lcs_sql, query, resolver_key_sql, times_similar_sql, with_norm

C = F.col

FEATURES = NORM + f""", feat AS (
  SELECT seq, CAST(date AS DATE) AS day, {resolver_key_sql('venue_name')} AS vkey, lower(venue_id) AS vid,
    {resolver_key_sql('bands[1]')} AS head,
    list_sort(list_distinct(list_transform(bands[2:], lambda b: {resolver_key_sql('b')}))) AS supports,
    len(bands) > 1 AS many, "time" AS t, price_advance AS adv, price_door AS door, age_requirement AS age FROM norm),
names AS (SELECT DISTINCT head AS n FROM feat UNION SELECT DISTINCT unnest(supports) FROM feat
  UNION SELECT DISTINCT vkey FROM feat),
ratios AS MATERIALIZED (SELECT a.n AS a, b.n AS b, {lcs_sql('a.n', 'b.n')} AS lcs, length(a.n) + length(b.n) AS total
  FROM names a, names b),
near80 AS MATERIALIZED (SELECT a, b FROM ratios WHERE 200 * lcs >= 80 * total),
near90 AS MATERIALIZED (SELECT a, b FROM ratios WHERE 200 * lcs > 90 * total)
"""

# Headliner similarity: ratio, best window and token-set arms over distinct names.
HEADS = FEATURES + f""", hp AS (SELECT DISTINCT a.head AS a, b.head AS b FROM (SELECT DISTINCT head FROM feat) a, (SELECT DISTINCT head FROM feat) b),
spans AS (SELECT a, b, unnest(list_concat(
    list_transform(range(1, length(a)), lambda i: b[1:i]),
    list_concat(list_transform(range(length(b) - length(a)), lambda i: b[i + 1:i + length(a)]),
                list_transform(range(length(b) - length(a), length(b)), lambda i: b[i + 1:])))) AS w
  FROM hp WHERE length(a) <= length(b)),
span_lcs AS MATERIALIZED (SELECT a, w, {lcs_sql('a', 'w')} AS lcs FROM (SELECT DISTINCT a, w FROM spans)),
windows AS (SELECT DISTINCT a, b FROM spans JOIN span_lcs USING (a, w) WHERE 200 * lcs >= 95 * (length(a) + length(w))),
tok AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM hp),
tok2 AS (SELECT a, b, list_filter(ta, lambda x: list_contains(tb, x)) AS shr,
   array_to_string(list_sort(list_filter(ta, lambda x: NOT list_contains(tb, x))), ' ') AS da,
   array_to_string(list_sort(list_filter(tb, lambda x: NOT list_contains(ta, x))), ' ') AS db FROM tok),
tok3 AS (SELECT *, length(array_to_string(shr, ' ')) AS s, CASE WHEN len(shr) > 0 THEN 1 ELSE 0 END AS g FROM tok2),
tokens AS (SELECT a, b FROM tok3 WHERE (len(shr) > 0 AND (da = '' OR db = ''))
   OR 100 * ((2 * (s + g) + length(da) + length(db)) - (length(da) + length(db) - 2 * {lcs_sql('da', 'db')}))
      >= 95 * (2 * (s + g) + length(da) + length(db))
   OR (s > 0 AND (100 * (2 * s) >= 95 * (2 * s + g + length(da)) OR 100 * (2 * s) >= 95 * (2 * s + g + length(db))))),
same_head AS MATERIALIZED (SELECT a, b FROM near80 UNION SELECT a, b FROM windows UNION SELECT b, a FROM windows UNION SELECT a, b FROM tokens)
"""

DUPES = HEADS + f""", pr AS (
  SELECT a.day, a.seq AS sa, b.seq AS sb, a AS x, b AS y, {times_similar_sql('a.t', 'b.t')} AS near_time,
    EXISTS (SELECT 1 FROM same_head h WHERE h.a = a.head AND h.b = b.head) AS "similar",
    (a.many AND b.many) AS both_many
  FROM feat a JOIN feat b ON a.day = b.day AND a.seq < b.seq
  WHERE a.vid = b.vid OR EXISTS (SELECT 1 FROM near80 v WHERE v.a = a.vkey AND v.b = b.vkey)),
overlap AS (SELECT DISTINCT sa, sb FROM (SELECT sa, sb, unnest(x.supports) AS p, y.supports AS ys FROM pr WHERE both_many) q
  JOIN near80 n ON n.a = q.p WHERE list_contains(q.ys, n.b)),
votes AS (SELECT pr.*,
    2 + (CASE WHEN x.adv IS NOT NULL OR y.adv IS NOT NULL THEN 1 ELSE 0 END)
      + (CASE WHEN x.door IS NOT NULL OR y.door IS NOT NULL THEN 1 ELSE 0 END) + CAST(both_many AS INT) AS total,
    CAST(near_time AS INT) + CAST(x.age = y.age AS INT) + coalesce(CAST(x.adv = y.adv AS INT), 0)
      + coalesce(CAST(x.door = y.door AS INT), 0) + CAST(o.sa IS NOT NULL AS INT) AS hits
  FROM pr LEFT JOIN overlap o ON o.sa = pr.sa AND o.sb = pr.sb),
dupes AS MATERIALIZED (SELECT day, sa, sb FROM votes
  WHERE CASE WHEN "similar" THEN near_time ELSE total >= 3 AND hits >= total // 2 + 1 END)
"""

CLUSTERS = DUPES + """, node AS (
  SELECT day, seq, list(earlier) FILTER (WHERE earlier IS NOT NULL) AS earlier FROM (
    SELECT day, sb AS seq, sa AS earlier FROM dupes UNION ALL SELECT DISTINCT day, sa, NULL FROM dupes) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY seq) AS r FROM node),
fold(day, r, led) AS (
  SELECT DISTINCT day, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM node
  UNION ALL
  SELECT f.day, f.r + 1, CASE WHEN len(list_filter(coalesce(n.earlier, CAST([] AS BIGINT[])), lambda e: NOT list_contains(f.led, e))) > 0
     THEN list_append(f.led, n.seq) ELSE f.led END
  FROM fold f JOIN ranked n ON n.day = f.day AND n.r = f.r + 1),
last AS (SELECT day, arg_max(led, r) AS led FROM fold GROUP BY day),
assigned0 AS (SELECT n.seq, list_min(list_filter(n.earlier, lambda e: NOT list_contains(l.led, e))) AS leader
  FROM node n JOIN last l USING (day) WHERE list_contains(l.led, n.seq)),
assigned AS MATERIALIZED (SELECT seq, leader FROM assigned0 UNION SELECT DISTINCT leader, leader FROM assigned0)
"""

RICHNESS = (
    "CAST(CASE WHEN len(bands) > 0 THEN length(bands[1]) // 10 + CASE WHEN contains(bands[1], ':') OR contains(bands[1], '-') "
    "OR contains(lower(bands[1]), 'tour') THEN 5 ELSE 0 END ELSE 0 END + len(bands) * 2 "
    "+ CASE WHEN price_advance IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN price_door IS NOT NULL THEN 3 ELSE 0 END "
    "+ len(flags) * 4 + CASE WHEN coalesce(age_requirement, '') NOT IN ('', 'a/a') THEN 2 ELSE 0 END "
    "+ CASE WHEN coalesce(\"time\", '') NOT IN ('', '8pm') THEN 2 ELSE 0 END + len(genre_tags) "
    "+ CASE WHEN coalesce(source_url, '') <> '' THEN 2 ELSE 0 END AS INT)"
)
URL = "CASE WHEN seq % 4 <> 0 THEN 'https://shows.example/' || seq END"
SRC_RANK = "CASE source WHEN 'ticketmaster' THEN 1 WHEN 'scrape:safe_in_a_crowd' THEN 2 WHEN 'scrape:middle_east' THEN 3 WHEN 'scrape:do617' THEN 4 ELSE 99 END"
VENUE_SRC = "(NOT contains(source, 'ticketmaster') AND NOT contains(source, 'seatgeek') AND source NOT IN ('', 'unknown'))"

MERGE = CLUSTERS + f""", mem0 AS (
  SELECT n.*, a.leader, {URL} AS source_url FROM norm n JOIN assigned a USING (seq)),
mem AS (SELECT *, {RICHNESS} AS score, {SRC_RANK} AS rank, {VENUE_SRC} AS venue_src FROM mem0),
pos AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY -score, rank, seq) AS o FROM mem),
merged AS (SELECT leader AS seq, arg_min(id, o) AS id, arg_min(date, o) AS date, arg_min(venue_id, o) AS venue_id,
    arg_min(venue_name, o) AS venue_name, arg_min(venue_location, o) AS venue_location, arg_min(bands, o) AS base_bands,
    coalesce(arg_min(price_advance, o) FILTER (WHERE price_advance <> 0), list(price_advance ORDER BY o)[1]) AS price_advance,
    coalesce(arg_min(price_door, o) FILTER (WHERE price_door <> 0), list(price_door ORDER BY o)[1]) AS price_door,
    coalesce(arg_min("time", o) FILTER (WHERE "time" <> '8pm'), '8pm') AS "time",
    coalesce(arg_min(age_requirement, o) FILTER (WHERE age_requirement <> 'a/a'), 'a/a') AS age_requirement,
    list_sort(list_distinct(flatten(list(flags)))) AS flags, list_sort(list_distinct(flatten(list(genre_tags)))) AS genre_tags,
    CASE WHEN count(DISTINCT source) > 1 THEN 'merged:' || array_to_string(list_sort(list_distinct(list(source))), '+')
         ELSE arg_min(source, o) END AS source,
    CASE WHEN arg_min(venue_src, o) THEN coalesce(arg_min(source_url, o) FILTER (WHERE venue_src AND source_url IS NOT NULL), list(source_url ORDER BY o)[1])
         ELSE coalesce(arg_max(source_url, o) FILTER (WHERE venue_src AND source_url IS NOT NULL), list(source_url ORDER BY o)[1]) END AS source_url,
    count(*) AS members
  FROM pos GROUP BY leader)
"""

BANDS = MERGE + """, ev0 AS (SELECT leader, o, unnest(bands) AS band, generate_subscripts(bands, 1) AS i FROM pos WHERE o > 1),
ev AS (SELECT leader, band, row_number() OVER (PARTITION BY leader ORDER BY o, i) AS k FROM ev0),
sim AS (SELECT list(a || '|' || b) AS pairs FROM near90),
billing_fold(seq, k, bands) AS (
  SELECT seq, CAST(0 AS BIGINT), base_bands FROM merged
  UNION ALL
  SELECT f.seq, f.k + 1, CASE WHEN len(list_filter(f.bands, lambda x: list_contains(s.pairs, lower(x) || '|' || lower(e.band)))) > 0
     THEN f.bands ELSE list_append(f.bands, e.band) END
  FROM billing_fold f JOIN ev e ON e.leader = f.seq AND e.k = f.k + 1 CROSS JOIN sim s),
billed AS (SELECT seq, arg_max(bands, k) AS bands FROM billing_fold GROUP BY seq),
resolved AS (
  SELECT m.seq, id, date, venue_id, venue_name, venue_location, b.bands, age_requirement, price_advance, price_door, "time", flags,
    source, source_url, genre_tags FROM merged m JOIN billed b USING (seq)
  UNION ALL
  SELECT n.seq, id, date, venue_id, venue_name, venue_location, bands, age_requirement, price_advance, price_door, "time", flags,
    source, """ + URL.replace("seq", "n.seq") + """ AS source_url, genre_tags FROM norm n WHERE n.seq NOT IN (SELECT seq FROM assigned))
"""


def normalized(spark, d):
    """Normalized listings; three rows in four carry a link."""
    url = F.when(C("seq") % 4 != 0, F.concat(F.lit("https://shows.example/"), "seq"))
    return normalize_listings(listings(spark, d)).withColumn("source_url", url)


def flat(df):
    """Arrays as text, for comparing."""
    arrays = [n for n, t in df.dtypes if t.startswith("array")]
    for n in arrays:
        df = df.withColumn(n, F.array_join(n, "|"))
    return df


@query("similar_names", f"""WITH names AS (SELECT DISTINCT lower(regexp_extract(s_name || ' ' || s_nationkey, '[0-9]+ .*')) AS n FROM supplier),
  r AS (SELECT a.n AS a, b.n AS b, {lcs_sql('a.n', 'b.n')} AS lcs FROM names a, names b WHERE a.n < b.n)
  SELECT a, b FROM r WHERE 200 * lcs >= 80 * (length(a) + length(b))""")
def similar_names(spark, d):
    s = table(spark, d, "supplier")
    name = F.lower(F.regexp_extract(F.concat_ws(" ", "s_name", "s_nationkey"), "[0-9]+ .*", 0))
    return similar_pairs(s.select(name.alias("n")), "n")


@query("indel_ratio_pairs", f"""WITH names AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS n FROM part),
  pairs AS (SELECT n AS a, lead(n) OVER (ORDER BY n) AS b FROM names)
  SELECT a, b, CAST(200 * {lcs_sql('a', 'b')} AS DOUBLE) / (length(a) + length(b)) AS ratio FROM pairs WHERE b IS NOT NULL""")
def indel_ratio_pairs(spark, d):
    """Ratio of each distinct name to the next one in order."""
    names = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("a")).distinct()
    return neighbours(names).select("a", "b", fuzzy.indel_ratio("a", "b").alias("ratio"))


def neighbours(names):
    """Each value with the next larger one: windows per initial, joined at their edges."""
    from pyspark.sql import Window

    part = names.withColumn("initial", F.substring("a", 1, 1))
    edges = part.groupBy("initial").agg(F.min("a").alias("lowest"))
    following = edges.select("initial", F.lead("lowest").over(Window.orderBy("initial")).alias("next_lowest"))
    w = Window.partitionBy("initial").orderBy("a")
    inner = part.withColumn("in_part", F.lead("a").over(w)).join(following, "initial")
    return inner.select("a", F.coalesce("in_part", "next_lowest").alias("b")).where("b IS NOT NULL")


@query("venue_similar_pairs", "WITH " + FEATURES + """, vk AS (SELECT DISTINCT vkey FROM feat) SELECT n.a, n.b FROM near80 n
  JOIN vk x ON x.vkey = n.a JOIN vk y ON y.vkey = n.b WHERE n.a < n.b""")
def venue_similar_pairs(spark, d):
    return similar_pairs(resolve.features(normalized(spark, d)), "vkey")


@query("headliner_similar_pairs", "WITH " + FEATURES + """, hd AS (SELECT DISTINCT head FROM feat) SELECT n.a, n.b FROM near80 n
  JOIN hd x ON x.head = n.a JOIN hd y ON y.head = n.b WHERE n.a < n.b""")
def headliner_similar_pairs(spark, d):
    return similar_pairs(resolve.features(normalized(spark, d)), "head")


@query("same_day_pairs", with_norm("""SELECT CAST(date AS DATE) AS day, count(*) AS listings, count(*) * (count(*) - 1) // 2 AS pairs
  FROM norm GROUP BY 1"""))
def same_day_pairs(spark, d):
    """Size of the naive comparison per day: counted, not formed."""
    n = F.count("*")
    return normalized(spark, d).groupBy(F.to_date("date").alias("day")).agg(
        n.alias("listings"), F.floor(n * (n - 1) / 2).cast("bigint").alias("pairs")
    )


@query("leader_clusters", "WITH RECURSIVE " + CLUSTERS + " SELECT seq, leader FROM assigned")
def leader_clusters(spark, d):
    return resolve.clusters(cut_lineage(normalized(spark, d).select(*resolve.READ)))


@query("duplicate_pairs", "WITH RECURSIVE " + CLUSTERS + """ SELECT v.day, a.leader, a.seq, v."similar", v.near_time, CAST(v.total AS INT) AS total,
    CAST(v.hits - CAST(o.sa IS NOT NULL AS INT) AS INT) AS hits
  FROM assigned a JOIN votes v ON v.sa = a.leader AND v.sb = a.seq LEFT JOIN overlap o ON o.sa = v.sa AND o.sb = v.sb""")
def duplicate_pairs(spark, d):
    """Each absorbed listing with its leader and the facts that made them one show."""
    rows = cut_lineage(resolve.elected(cut_lineage(normalized(spark, d).select(*resolve.READ))))
    cols = [c.alias(n) for n, c in resolve.feature_columns().items()]
    a = rows.where("seq = leader").select("seq", *cols).alias("a")
    b = rows.where("seq <> leader").select("seq", "leader", *cols).alias("b")
    pairs = a.join(b, C("a.seq") == C("b.leader"))
    facts = resolve.match_facts(pairs).where(resolve.is_match())
    return facts.select(
        C("a.day").alias("day"), C("b.leader").alias("leader"), C("b.seq").alias("seq"), "similar", "near_time",
        "total", "hits",
    )


@query("richness", with_norm(f"SELECT seq, {RICHNESS} AS score, {SRC_RANK} AS source_rank FROM (SELECT *, {URL} AS source_url FROM norm)"))
def richness(spark, d):
    return normalized(spark, d).select(
        "seq", resolve.richness().alias("score"), resolve.source_rank(C("source")).alias("source_rank")
    )


@query("merge_fold", "WITH RECURSIVE " + MERGE + """ SELECT seq, id, date, venue_id, venue_name, venue_location, array_to_string(base_bands, '|') AS bands,
  age_requirement, price_advance, price_door, "time", array_to_string(flags, '|') AS flags, source, source_url,
  array_to_string(genre_tags, '|') AS genre_tags, members FROM merged""")
def merge_fold(spark, d):
    members = resolve.elected(cut_lineage(normalized(spark, d))).where("leader IS NOT NULL")
    return flat(resolve.merge_fields(members).drop("base_ord"))


@query("band_fold", "WITH RECURSIVE " + BANDS + " SELECT seq, array_to_string(bands, '|') AS bands FROM billed")
def band_fold(spark, d):
    rows = cut_lineage(normalized(spark, d).drop("id", "venue_location"))
    members = cut_lineage(resolve.elected(rows).where("leader IS NOT NULL"))
    return flat(resolve.merge_bands(members, cut_lineage(resolve.bases(members))))


@query("dedup_counts", "WITH RECURSIVE " + BANDS + """ SELECT (SELECT count(*) FROM norm) AS before, (SELECT count(*) FROM resolved) AS after,
  (SELECT count(*) FROM norm) - (SELECT count(*) FROM resolved) AS removed""")
def dedup_counts(spark, d):
    rows = cut_lineage(normalized(spark, d))
    return resolve.stage_counts(rows, resolve.deduplicate(rows))


@query("processed", "WITH RECURSIVE " + BANDS + f""" SELECT seq, id, date, venue_id, venue_name, venue_location, array_to_string(bands, '|') AS bands,
  age_requirement, price_advance, price_door, "time", array_to_string(flags, '|') AS flags, source, source_url,
  array_to_string(genre_tags, '|') AS genre_tags FROM resolved WHERE date >= DATE '{AS_OF}'""")
def processed_listings(spark, d):
    url = F.when(C("seq") % 4 != 0, F.concat(F.lit("https://shows.example/"), "seq"))
    return flat(processed(listings(spark, d).withColumn("source_url", url), AS_OF))
