"""Chat formatting in budgeted windows, by DataFrame functions alone.

A conversation's turns, in order, become windows of formatted text. A window holds the
conversation's leading system turn, some repeated history and a span of new turns; every turn is
new in one window. A turn of a window is written

    <s>role\\n[INST]\\ntext\\n</s>\\n

and control strings inside texts and roles are escaped: a backslash is doubled, one is put
before a control string, and a line feed in a role becomes `\\n`. Undoing reads from left to right.

Prefix sums of turn tokens (white-space separated words and a fixed cost per turn) choose the
spans: turns join the window while their tokens fit what the budget leaves after the system turn
and the history; a turn that alone exceeds it has a window of its own. Repeated are the last turns before
the span, ``HISTORY_TURNS`` at most, that fit ``HISTORY_TOKENS``. The loss covers the texts of new
assistant turns; targets that are repeated as history are masked.

Conversations are worked on in blocks of ``BLOCK`` turn numbers; a window ends with its block, and a
block's last turns are also sent to the next one as history. So a conversation of any length is
spread over tasks, and only its windows meet, in the digests of the query.

Null texts and roles are empty. Turns are ordered by number (null first), role and text; repeated rows are each
a turn, kept once with a count until they are formatted. Rows without ``conv_id`` form one
conversation. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 512
TURN_COST = 4
HISTORY_TURNS, HISTORY_TOKENS = 2, 128
BLOCK = 64
_CONTROL = r"(</?s>|\[/?INST\])"
_OPEN, _MIDDLE, _CLOSE = "<s>", "\n[INST]\n", "\n</s>\n"
#: A real control string: none in a text is without a backslash before it.
_TURN_END = r"\n</s>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # "\\n" stands for a line feed unless its backslash is the second of a pair.
    return unescape(F.regexp_replace(role, r"((?<!\\)(?:\\\\)*)\\n", "$1\n"))


def _tokens(role: Column, text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")) + TURN_COST


def blocks(rows: DataFrame) -> DataFrame:
    """``conv_id, block, turns``: new turns of the block and, marked ``old``, the last of the one before."""
    clean = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    counted = clean.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62)))
    last = F.col("turn").isNotNull() & (F.pmod("turn", F.lit(BLOCK)) >= BLOCK - HISTORY_TURNS)
    places = F.when(last, F.array(F.struct(block.alias("block"), F.lit(False).alias("old")), F.struct((block + 1).alias("block"), F.lit(True).alias("old"))))
    dealt = counted.withColumn("at", F.explode(F.coalesce(places, F.array(F.struct(block.alias("block"), F.lit(False).alias("old"))))))
    turn = F.struct((~F.col("at.old")).alias("new"), "turn", "role", "text", "times")
    listed = dealt.groupBy("conv_id", F.col("at.block").alias("block")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    one = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["new"].alias("new"), _tokens(t["role"], t["text"]).alias("tokens"))
    each = F.flatten(F.transform("turns", lambda t: F.array_repeat(one(t), t["times"].cast("int"))))
    return listed.where(F.exists("turns", lambda t: t["new"])).select("conv_id", "block", each.alias("turns"))


def windows(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``conv_id, block, window, formatted, n_context, loss``: formatted windows.

    The first ``n_context`` turns are the system turn and history; ``loss`` lists (start, length) in
    code points, 1-based, of the text that is trained on.
    """
    grouped = blocks(rows)
    first = grouped.groupBy("conv_id").agg(F.min_by(F.element_at("turns", 1), "block").alias("head"), F.min("block").alias("first_block"))
    head = F.when(F.col("head.role") == "system", F.col("head"))
    known = grouped.join(
        first.select(F.col("conv_id").alias("__id"), head.alias("system"), "first_block"), F.col("conv_id").eqNullSafe(F.col("__id"))
    ).drop("__id")
    old = F.size(F.filter("turns", lambda t: ~t["new"]))
    room = F.greatest(F.lit(budget - HISTORY_TOKENS) - F.coalesce(F.col("system.tokens"), F.lit(0)), F.lit(budget // 4))
    # Prefix sums before each turn, and the window of each: 0 for history from the block before.
    sums = F.transform(
        F.sequence(F.lit(0), F.size("turns")), lambda k: F.aggregate(F.slice("turns", 1, k), F.lit(0), lambda s, t: s + t["tokens"])
    )
    state = F.struct(F.lit(0).alias("start"), F.lit(0).alias("window"), F.array().cast("array<int>").alias("all"))
    step = lambda s, k: F.when(
        (s["window"] > 0) & (F.element_at("sums", k + 1) - s["start"] <= F.col("room")),
        F.struct(s["start"].alias("start"), s["window"].alias("window"), F.concat(s["all"], F.array(s["window"])).alias("all")),
    ).otherwise(
        F.struct(F.element_at("sums", k).alias("start"), (s["window"] + 1).alias("window"), F.concat(s["all"], F.array(s["window"] + 1)).alias("all"))
    )
    numbered = known.select("*", old.alias("old"), room.cast("int").alias("room"), sums.alias("sums")).withColumn(
        "places", F.aggregate(F.sequence(F.col("old") + 1, F.size("turns")), state, step)["all"]
    )
    spans = numbered.withColumn("window", F.explode(F.array_distinct("places")))
    start = F.array_position("places", F.col("window")).cast("int") + F.col("old")
    size = F.size(F.filter("places", lambda p: p == F.col("window")))
    spans = spans.select("*", start.alias("start"), size.alias("size"))
    leads = (F.col("block") == F.col("first_block")) & F.col("system").isNotNull()
    has_system = F.col("system").isNotNull() & ~(leads & (F.col("start") == F.col("old") + 1))
    # History: turns i < start with start - i <= HISTORY_TURNS whose sum up to the span fits; not the system turn again.
    since = F.element_at(
        F.filter(
            F.sequence(F.greatest(F.col("start") - HISTORY_TURNS, F.when(leads, F.col("old") + 2).otherwise(F.lit(1))), F.col("start")),
            lambda i: F.element_at("sums", F.col("start")) - F.element_at("sums", i) <= HISTORY_TOKENS,
        ),
        1,
    )
    since = F.when(F.col("start") <= F.when(leads, F.col("old") + 1).otherwise(F.lit(1)), F.col("start")).otherwise(since)
    history = F.slice("turns", F.col("since"), F.col("start") - F.col("since"))
    system = F.when(F.col("has_system"), F.array("system")).otherwise(F.slice("turns", 1, 0))
    shown = spans.select("*", has_system.alias("has_system"), since.cast("int").alias("since")).select(
        "conv_id", "block", "window", F.concat(system, history).alias("context"), F.slice("turns", F.col("start"), F.col("size")).alias("fresh")
    )
    before = lambda t: F.concat(F.lit(_OPEN), escape_role(t["role"]), F.lit(_MIDDLE))
    written = lambda t: F.concat(before(t), escape(t["text"]), F.lit(_CLOSE))
    parts = lambda c: F.transform(c, lambda t: F.struct(written(t).alias("text"), F.length(before(t)).alias("lead"), (t["role"] == "assistant").alias("aim")))
    cut = shown.select("conv_id", "block", "window", parts("context").alias("context"), parts("fresh").alias("fresh"))
    formatted = F.array_join(F.transform(F.concat("context", "fresh"), lambda p: p["text"]), "")
    ahead = F.aggregate("context", F.lit(0), lambda s, p: s + F.length(p["text"]))
    loss_kind = "array<struct<start:int,length:int>>"
    loss = F.aggregate(
        "fresh",
        F.struct(ahead.alias("at"), F.array().cast(loss_kind).alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["text"])).alias("at"),
            F.when(
                p["aim"],
                F.concat(s["spans"], F.array(F.struct(
                    (s["at"] + p["lead"] + 1).alias("start"), (F.length(p["text"]) - p["lead"] - len(_CLOSE)).alias("length"))))
            ).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    return cut.select("conv_id", "block", "window", formatted.alias("formatted"), F.size("context").alias("n_context"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns`` (role, text) that are new in each window, and the unescaped ``targets`` under the loss mask."""
    raw = F.slice(F.split("formatted", _TURN_END), F.col("n_context") + 1, F.lit(1 << 30))
    kept = F.filter(raw, lambda t: t != "")
    body = lambda t: F.substr(t, F.lit(len(_OPEN) + 1))
    cut = lambda t: F.instr(body(t), _MIDDLE)
    turns = F.transform(kept, lambda t: F.struct(
        unescape_role(F.substr(body(t), F.lit(1), cut(t) - 1)).alias("role"),
        unescape(F.substr(body(t), cut(t) + len(_MIDDLE))).alias("text"),
    ))
    targets = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"], s["length"])))
    return formatted.select("conv_id", "block", "window", F.length("formatted").alias("size"), turns.alias("turns"), targets.alias("targets"))


#: The conversation that every query adds; it talks like the template.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*columns)
    extra = spark.createDataFrame(EXTRA, "conv_id bigint, turn bigint, role string, text string")
    back = read_back(windows(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    pieces = back.select(
        "conv_id", F.struct("block", "window", said.alias("said"), F.array_join("targets", "").alias("aimed")).alias("w"),
        F.size("turns").alias("n"), "size",
    )
    whole = pieces.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("all"), F.sum("size").cast("bigint").alias("formatted_chars")
    )
    joined = lambda part: F.array_join(F.transform("all", lambda w: w[part]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("aimed")).cast("bigint").alias("loss_chars"),
        F.sha2(joined("aimed"), 256).alias("loss_sha256"), "formatted_chars",
    )
