"""Entity resolution: duplicate test, clusters, merge.

Steps of :func:`deduplicate`:

1. split each day by connected groups of venue names, found on distinct names;
2. move whole listings once, by day and venue group, and elect leaders in one sorted
   pass over each block (:mod:`gigmesh.operators.elect`);
3. merge clusters with aggregates that combine map-side, where a block's rows already
   are together; unmatched rows pass by.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gigmesh import fixed_values as fx
from gigmesh.functions import fuzzy, temporal, text
from gigmesh.operators import cluster, elect
from gigmesh.operators.similar import similar_pairs
from gigmesh.runtime import cut_lineage


#: Columns that the duplicate test reads.
READ = ["seq", "date", "venue_id", "venue_name", "bands", "time", "price_advance", "price_door", "age_requirement"]


# -- duplicate test -----------------------------------------------------------


def feature_columns() -> dict[str, Column]:
    """The fields that decide whether two listings are duplicates, by name."""
    name = F.when(text.blank(F.col("venue_name")), F.col("venue_id")).otherwise(F.col("venue_name"))
    support = F.transform(F.slice("bands", 2, 1 << 30), text.resolver_key)
    return {
        "day": F.to_date("date"),
        "vkey": text.resolver_key(F.coalesce(name, F.lit(""))),
        "vid": F.lower(F.coalesce("venue_id", F.lit(""))),
        "head": F.when(F.size("bands") > 0, text.resolver_key(F.element_at("bands", 1))),
        "supports": F.array_sort(F.array_distinct(F.coalesce(support, F.array().cast("array<string>")))),
        "many": F.size("bands") > 1,
        "time": F.coalesce("time", F.lit("")),
        "minutes": temporal.time_to_minutes(F.col("time")),
        "adv": F.col("price_advance"),
        "door": F.col("price_door"),
        "age": F.coalesce("age_requirement", F.lit("")),
    }


def features(listings: DataFrame) -> DataFrame:
    """``seq`` and the fields that decide whether two listings are duplicates."""
    return listings.select("seq", *[c.alias(n) for n, c in feature_columns().items()])


def same_venue(pairs: DataFrame) -> DataFrame:
    """Keep pairs whose venue ids agree or whose venue names are close."""
    a, b = F.col("a.vkey"), F.col("b.vkey")
    same_id = (F.col("a.vid") != "") & (F.col("a.vid") == F.col("b.vid"))
    sure = (a == b) | same_id
    # Decided pairs are blanked so the ratio is only computed where it matters.
    common = fuzzy.lcs_batch(F.when(~sure, a), F.when(~sure, b))
    return pairs.where(sure | (common * 200 >= (F.length(a) + F.length(b)) * fx.NAME_RATIO))


def _near_time() -> Column:
    return temporal.minutes_similar(F.col("a.minutes"), F.col("b.minutes"), F.col("a.time"), F.col("b.time"))


def _vote(a_many: Column, b_many: Column):
    """Checks made and matched between two listings, support overlap left out."""
    checks, hits = [], []

    def check(made: Column, same: Column):
        checks.append(F.when(made, 1).otherwise(0))
        hits.append(F.when(made & F.coalesce(same, F.lit(False)), 1).otherwise(0))

    check((F.col("a.time") != "") & (F.col("b.time") != ""), _near_time())
    for price in ("adv", "door"):
        x, y = F.col(f"a.{price}"), F.col(f"b.{price}")
        check(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y))
    check((F.col("a.age") != "") & (F.col("b.age") != ""), F.col("a.age") == F.col("b.age"))
    total = sum(checks[1:], checks[0]) + F.when(a_many & b_many, 1).otherwise(0)
    return total, sum(hits[1:], hits[0])


def match_facts(pairs: DataFrame) -> DataFrame:
    """Venue-matching pairs with the facts of the duplicate test.

    ``similar`` headliners, ``near_time`` (unknown times never clash), and for the
    vote the checks made (``total``), matched without support overlap (``hits``) and
    needed (``need``). ``overlap`` of supporting acts is only computed where the
    vote depends on it and is false elsewhere.
    """
    row = same_venue(pairs).select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"))
    at, bt = F.col("a.time"), F.col("b.time")
    total, hits = _vote(F.col("a.many"), F.col("b.many"))
    row = row.select(
        "a",
        "b",
        # Blocks hold many pairs of few names: batches that remember them beat interpreted columns by two to one.
        fuzzy.same_performer_batch(F.col("a.head"), F.col("b.head")).alias("similar"),
        ((at == "") | (bt == "") | _near_time()).alias("near_time"),
        total.alias("total"),
        hits.alias("hits"),
        (F.floor(total / 2) + 1).cast("int").alias("need"),
    )
    close_call = ~F.col("similar") & (F.col("total") >= 3) & (F.col("hits") + 1 == F.col("need"))
    close_call = close_call & F.col("a.many") & F.col("b.many")
    overlap = fuzzy.any_close_batch(F.when(close_call, F.col("a.supports")), F.when(close_call, F.col("b.supports")))
    return row.withColumn("overlap", overlap)


def is_match() -> Column:
    """Duplicate decision over :func:`match_facts`: similar headliners need compatible
    times, other pairs a majority of at least three known facts."""
    votes = F.col("hits") + F.col("overlap").cast("int")
    return F.when(F.col("similar"), F.col("near_time")).otherwise((F.col("total") >= 3) & (votes >= F.col("need")))


def duplicates(pairs: DataFrame) -> DataFrame:
    """Keep the pairs (aliases ``a`` and ``b``, same day) that are the same show."""
    return match_facts(pairs).where(is_match()).select("a", "b")


# -- blocks --------------------------------------------------------------------


def venue_groups(nodes: DataFrame) -> DataFrame:
    """Connected groups of venue names: ``(vkey, venue_group)``.

    Edges are close names and shared ids. Labels spread over the distinct names
    until none changes.
    """
    venues = cut_lineage(nodes.select("vkey", "vid").distinct())
    by_id = (
        venues.where("vid <> ''").groupBy("vid").agg(F.min("vkey").alias("a")).join(venues, "vid").select("a", F.col("vkey").alias("b"))
    )
    close = similar_pairs(venues, "vkey")
    one_way = close.unionByName(by_id).where("a <> b")
    edges = cut_lineage(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = venues.select("vkey", F.col("vkey").alias("venue_group")).distinct()
    if edges.isEmpty():
        return labels
    while True:
        spread = (
            edges.join(labels, F.col("a") == F.col("vkey")).groupBy("b").agg(F.min("venue_group").alias("near"))
        )
        moved = cut_lineage(
            labels.join(spread, F.col("vkey") == F.col("b"), "left").select(
                "vkey", F.least("venue_group", F.coalesce("near", "venue_group")).alias("new"), "venue_group"
            )
        )
        # Follow each label to that label's own label, which halves long chains.
        heads = moved.select(F.col("vkey").alias("h"), F.col("new").alias("head"))
        next_labels = cut_lineage(
            moved.join(heads, F.col("new") == F.col("h"), "left").select(
                "vkey", F.coalesce("head", "new").alias("venue_group"), "venue_group"
            ).toDF("vkey", "venue_group", "old")
        )
        labels = next_labels.select("vkey", "venue_group")
        if next_labels.where("venue_group <> old").isEmpty():
            return labels


def elected(listings: DataFrame) -> DataFrame:
    """``listings`` with the ``leader`` of each row; rows without any match have none. Read twice, so best a stored table.

    Rows move once, by day and venue group, and venue groups are found on distinct raw names.
    """
    columns, cols = listings.columns, feature_columns()
    raw = listings.select("venue_id", "venue_name").distinct()
    named = cut_lineage(raw.select("*", cols["vkey"].alias("vkey"), cols["vid"].alias("vid")))
    places = named.join(venue_groups(named), "vkey").select("venue_id", "venue_name", F.col("vkey").alias("__vkey"), F.col("venue_group").alias("__group"))
    same = F.col("r.venue_id").eqNullSafe(F.col("p.venue_id")) & F.col("r.venue_name").eqNullSafe(F.col("p.venue_name"))
    rows = listings.alias("r").join(cut_lineage(places).alias("p"), same).select("r.*", "__vkey", "__group")
    blocks = rows.repartition(cols["day"], "__group").sortWithinPartitions(cols["day"], "__group", "seq")
    fields = [f"__{f}" for f in elect.FIELDS]
    own = [cols[f].alias(f"__{f}") for f in ("day", *elect.FIELDS) if f != "vkey"]
    block = ["__day", "__group"]
    schema = T.StructType([*listings.schema.fields, T.StructField("leader", T.LongType())])
    return blocks.select("*", *own).mapInArrow(lambda batches: elect.with_leaders(batches, columns, block, fields), schema)


def clusters(listings: DataFrame) -> DataFrame:
    """``(seq, leader)`` for every listing of a cluster with two or more members."""
    return elected(listings.select(*READ)).where("leader IS NOT NULL").select("seq", "leader")


# -- merge --------------------------------------------------------------------


def richness(prefix: str = "") -> Column:
    """How much a listing tells; the richest one leads the merge."""
    c = lambda n: F.col(prefix + n)
    head = F.try_element_at(c("bands"), F.lit(1))
    titled = head.contains(":") | head.contains("-") | F.lower(head).contains("tour")
    points = (
        F.when(F.size(c("bands")) > 0, F.floor(F.length(head) / 10) + F.when(titled, 5).otherwise(0)).otherwise(0)
        + F.greatest(F.size(c("bands")), F.lit(0)) * 2
        + F.when(c("price_advance").isNotNull(), 3).otherwise(0)
        + F.when(c("price_door").isNotNull(), 3).otherwise(0)
        + F.greatest(F.size(c("flags")), F.lit(0)) * 4
        + F.when(~text.blank(c("age_requirement")) & (c("age_requirement") != fx.DEFAULT_AGE), 2).otherwise(0)
        + F.when(~text.blank(c("time")) & (c("time") != fx.DEFAULT_TIME), 2).otherwise(0)
        + F.greatest(F.size(c("genre_tags")), F.lit(0))
        + F.when(~text.blank(c("source_url")), 2).otherwise(0)
    )
    return points.cast("int")


def source_rank(source: Column) -> Column:
    ranks = text.literal_map(fx.SOURCE_PRIORITY)
    return F.coalesce(F.try_element_at(ranks, source), F.lit(fx.SOURCE_PRIORITY_OTHER))


def is_venue_source(source: Column) -> Column:
    low = F.lower(F.coalesce(source, F.lit("")))
    return ~low.contains("ticketmaster") & ~low.contains("seatgeek") & ~low.isin("", "unknown")


def merge_order() -> Column:
    return F.struct(
        (-richness()).alias("poor"), source_rank(F.col("source")).alias("rank"), F.col("seq").alias("seq")
    )


def _first(value: Column, keep: Column) -> Column:
    """Value of the first row in merge order for which ``keep`` holds."""
    return F.min(F.when(keep, F.struct(F.col("ord"), value.alias("v"))))["v"]


def bases(members: DataFrame) -> DataFrame:
    """``seq, bands, base_ord``: the row that leads each merge."""
    first = members.groupBy("leader").agg(F.min(F.struct(merge_order().alias("ord"), "bands")).alias("base"))
    return first.select(F.col("leader").alias("seq"), "base.bands", F.col("base.ord").alias("base_ord"))


def merge_fields(members: DataFrame) -> DataFrame:
    """One row per cluster from ``leader`` plus listing columns; bands are the base's.

    Every field is a minimum or maximum over the merge order or a distinct set, so
    partial results combine before the shuffle and no cluster is collected.
    """
    base_columns = [c for c in members.columns if c not in ("seq", "leader")]
    ranked = members.withColumn("ord", merge_order())
    url_ok = ~text.blank(F.col("source_url")) & is_venue_source(F.col("source"))
    url = F.when(url_ok, F.struct("ord", F.col("source_url").alias("v")))
    merged = ranked.groupBy("leader").agg(
        F.min(F.struct("ord", *base_columns)).alias("base"),
        F.count("*").alias("members"),
        _first(F.col("price_advance"), F.col("price_advance") != 0).alias("adv"),
        _first(F.col("price_door"), F.col("price_door") != 0).alias("door"),
        _first(F.col("time"), F.col("time") != fx.DEFAULT_TIME).alias("time"),
        _first(F.col("age_requirement"), F.col("age_requirement") != fx.DEFAULT_AGE).alias("age"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("flags"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("genre_tags")))).alias("genre_tags"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min(url)["v"].alias("url_first"),
        F.max(url)["v"].alias("url_last"),
    )
    base = lambda n: F.col("base")[n]
    replaced = {
        "price_advance": F.coalesce("adv", base("price_advance")),
        "price_door": F.coalesce("door", base("price_door")),
        "time": F.when(base("time") == fx.DEFAULT_TIME, F.coalesce("time", base("time"))).otherwise(base("time")),
        "age_requirement": F.when(
            base("age_requirement") == fx.DEFAULT_AGE, F.coalesce("age", base("age_requirement"))
        ).otherwise(base("age_requirement")),
        "flags": F.col("flags"),
        "genre_tags": F.col("genre_tags"),
        "source": F.when(F.size("sources") > 1, F.concat(F.lit("merged:"), F.array_join("sources", "+"))).otherwise(
            base("source")
        ),
        "source_url": F.when(is_venue_source(base("source")), F.coalesce("url_first", base("source_url"))).otherwise(
            F.coalesce("url_last", base("source_url"))
        ),
    }
    out = [replaced.get(c, base(c)).alias(c) for c in base_columns]
    return merged.select(F.col("leader").alias("seq"), *out, F.col("base")["ord"].alias("base_ord"), "members")


# -- billing of a merged show ------------------------------------------------------

FOLDED = T.StructType(
    [T.StructField("bands", T.ArrayType(T.StringType())), T.StructField("ordered", T.BooleanType())]
)


def add_bands(current: list[str], bands) -> tuple[list[str], bool]:
    """Fold a billing into ``current``: near-equal names are one act, far longer forms replace.

    Returns the new list and whether a name was replaced.
    """
    out, replaced = list(current), False
    for band in bands:
        if not band:
            continue
        for i, known in enumerate(out):
            if fuzzy.ratio_of(band.lower(), known.lower()) > fx.BAND_MERGE_ABOVE:
                if len(band) > len(known) + fx.BAND_UPGRADE_EXTRA_CHARS:
                    out[i], replaced = band, True
                break
        else:
            out.append(band)
    return out, replaced


@F.pandas_udf(FOLDED)
def fold_names(base: pd.Series, others: pd.Series) -> pd.DataFrame:
    """Fold distinct names in first-seen order; ``ordered`` tells that repeats could matter."""
    bands, ordered = [], []
    for own, more in zip(base, others):
        names = list(dict.fromkeys([*own, *more]))
        long = [n for n in names if len(n) > 27]
        ordered.append(
            any(
                len(x) > len(y) + fx.BAND_UPGRADE_EXTRA_CHARS
                and fuzzy.ratio_of(x.lower(), y.lower()) > fx.BAND_MERGE_ABOVE
                for x in long
                for y in names
            )
        )
        bands.append(add_bands(own, more)[0])
    return pd.DataFrame({"bands": bands, "ordered": ordered})


def merge_bands(members: DataFrame, merged: DataFrame, size: int = cluster.FIRST_ROUND) -> DataFrame:
    """``(seq, bands)`` of each merged show.

    Unless a longer form can replace a shorter one, repeated names change nothing,
    so each cluster is folded over its distinct names, which the merged row holds
    anyway. The few clusters with replaceable names are folded row by row in
    rounds (:func:`fold_in_rounds`).
    """
    ranked = members.select("leader", "bands", merge_order().alias("ord"))
    bases = merged.select(F.col("seq").alias("leader"), "base_ord", F.col("bands").alias("base_bands"))
    names = (
        ranked.select("leader", "ord", F.posexplode("bands").alias("i", "band"))
        .groupBy("leader", "band")
        .agg(F.min(F.struct("ord", "i")).alias("at"))
        .groupBy("leader")
        .agg(F.array_sort(F.collect_list(F.struct("at", "band"))).alias("names"))
    )
    folded = bases.join(names, "leader", "left").select(
        "leader",
        "base_ord",
        "base_bands",
        fold_names("base_bands", F.coalesce(F.transform("names", lambda x: x["band"]), F.array().cast("array<string>"))).alias("f"),
    )
    folded = cut_lineage(folded)
    plain = folded.where(~F.col("f.ordered")).select(F.col("leader").alias("seq"), "f.bands")
    ordered = folded.where(F.col("f.ordered")).select("leader", F.col("base_bands").alias("bands"), F.col("base_ord").alias("at"))
    if ordered.isEmpty():
        return plain
    return plain.unionByName(fold_in_rounds(ranked, ordered, size))


@F.pandas_udf(T.BooleanType())
def changes_billing(current: pd.Series, bands: pd.Series) -> pd.Series:
    return pd.Series([add_bands(list(c), b)[0] != list(c) for c, b in zip(current, bands)], dtype="bool")


STEPPED = T.StructType(
    [T.StructField("bands", T.ArrayType(T.StringType())), T.StructField("used", T.IntegerType())]
)


@F.pandas_udf(STEPPED)
def fold_rows(current: pd.Series, rows: pd.Series) -> pd.DataFrame:
    """Fold billings in order, stopping after the first replacement."""
    bands, used = [], []
    for state, billings in zip(current, rows):
        state, n = list(state), 0
        for billing in billings:
            state, replaced = add_bands(state, billing)
            n += 1
            if replaced:
                break
        bands.append(state)
        used.append(n)
    return pd.DataFrame({"bands": bands, "used": used})


def fold_in_rounds(ranked: DataFrame, states: DataFrame, size: int) -> DataFrame:
    """Exact fold of long clusters: ``states`` is ``(leader, bands, at)``.

    A round looks only at the next ``size`` rows of each cluster that would change
    its billing. Appending names never turns an idle row into a changing one, so
    rows between them are done; after a replacement the rest is looked at anew.
    """
    states = cut_lineage(states)
    while True:
        joined = ranked.join(states.withColumnRenamed("bands", "current"), "leader").where(F.col("ord") > F.col("at"))
        active = joined.where(changes_billing("current", "bands"))
        head = cluster.first_of_block(active, size, "leader", "ord")
        work = cut_lineage(
            head.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("ord", "bands"))).alias("rows"))
        )
        if work.isEmpty():
            return states.select(F.col("leader").alias("seq"), "bands")
        folded = (
            states.join(work, "leader", "left")
            .withColumn("f", fold_rows("bands", F.coalesce(F.transform("rows", lambda r: r["bands"]), F.array().cast("array<array<string>>"))))
            .select(
                "leader",
                F.when(F.col("rows").isNull(), F.col("bands")).otherwise(F.col("f.bands")).alias("bands"),
                F.coalesce(F.try_element_at("rows", F.col("f.used"))["ord"], F.col("at")).alias("at"),
            )
        )
        states = cut_lineage(folded)


def deduplicate(listings: DataFrame, size: int = cluster.FIRST_ROUND) -> DataFrame:
    """Listings with every cluster merged into one row at its leader's place."""
    # Stored rows of a cluster lie side by side, so merges combine before they move.
    rows = cut_lineage(elected(cut_lineage(listings)))
    single = rows.where("leader IS NULL").drop("leader")
    members = rows.where("leader IS NOT NULL")
    merged = cut_lineage(merge_fields(members))
    bands = merge_bands(members, merged, size)
    whole = merged.drop("bands", "base_ord", "members").join(bands, "seq")
    return single.unionByName(whole.select(*single.columns))


def stage_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """``before``, ``after`` and ``removed`` of a stage as one row."""
    tagged = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return tagged.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("before"), F.coalesce(F.sum("a"), F.lit(0)).alias("after")
    ).withColumn("removed", F.col("before") - F.col("after"))
