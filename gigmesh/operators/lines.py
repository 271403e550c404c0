"""Position-dependent reading of text.

The lines of one text live in one array inside its row, so looking backwards,
ahead or around needs no shuffle and no window. Rows that are lines of a larger
group (one row per line) use :func:`neighbours`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gigmesh.functions.text import strip
from gigmesh.operators.numbering import numbered

Test = Callable[[Column], Column]


def lines_of(text: Column, keep_blank: bool = False) -> Column:
    """Stripped lines of a text; blank ones are dropped unless asked for."""
    lines = F.transform(F.split(text, "\n"), strip)
    return lines if keep_blank else F.filter(lines, lambda s: s != "")


def _positions(lines: Column, test: Test) -> Column:
    """1-based positions of the lines that pass ``test``."""
    marked = F.transform(lines, lambda s, i: F.when(test(s), i + 1))
    return F.filter(marked, lambda p: p.isNotNull())


def carry_forward(df: DataFrame, lines: str, is_heading: Test, read: Callable[[Column], Column] = lambda heading: heading) -> DataFrame:
    """Lines with the heading that precedes them: ``heading``, ``pos``, ``line``.

    ``read`` makes ``heading`` from the heading's text, once per heading, not per line.

    Lines before the first heading have none and are dropped. Each text is cut at
    its headings, so a line is copied once however many headings there are.
    """
    keys = [c for c in df.columns if c != lines]
    marked = df.withColumn("__at", _positions(F.col(lines), is_heading))
    sections = F.transform(
        F.col("__at"),
        lambda at, k: F.struct(
            F.element_at(F.col(lines), at).alias("heading"),
            at.alias("at"),
            F.slice(
                F.col(lines),
                at + 1,
                F.coalesce(F.get(F.col("__at"), k + 1), F.size(lines) + 1) - at - 1,
            ).alias("body"),
        ),
    )
    # Sections are taken apart before their lines are, so that a line does not carry its whole section.
    cut = marked.select(*keys, F.explode(sections).alias("s")).select(
        *keys, read(F.col("s.heading")).alias("heading"), F.col("s.at").alias("__at"), F.col("s.body").alias("__body")
    )
    return cut.select(*keys, "heading", "__at", F.posexplode("__body").alias("__i", "line")).select(
        *keys, "heading", (F.col("__at") + F.col("__i") + 1).alias("pos"), "line"
    )


def around(df: DataFrame, lines: str, is_mark: Test, before: int = 0, after: int = 0) -> DataFrame:
    """One row per marked line: ``pos``, ``line``, ``previous`` (nearest first) and ``following``."""
    keys = [c for c in df.columns if c != lines]
    arr = F.col(lines)
    marked = df.withColumn("__at", _positions(arr, is_mark))
    frames = F.transform(
        F.col("__at"),
        lambda at: F.struct(
            at.alias("pos"),
            F.element_at(arr, at).alias("line"),
            F.reverse(
                F.slice(arr, F.greatest(at - before, F.lit(1)), at - F.greatest(at - before, F.lit(1)))
            ).alias("previous"),
            F.slice(arr, at + 1, F.lit(after)).alias("following"),
        ),
    )
    return marked.select(*keys, F.explode(frames).alias("f")).select(*keys, "f.pos", "f.line", "f.previous", "f.following")


def first_acceptable(candidates: Column, accept: Test, stop: Test) -> Column:
    """First accepted entry that comes before any stop entry, NULL when there is none."""
    verdicts = F.transform(
        candidates, lambda s: F.struct(s.alias("s"), F.when(stop(s), 1).when(accept(s), 0).alias("v"))
    )
    decided = F.try_element_at(F.filter(verdicts, lambda x: x["v"].isNotNull()), F.lit(1))
    return F.when(decided["v"] == 0, decided["s"])


def sessions(df: DataFrame, lines: str, is_heading: Test) -> DataFrame:
    """Runs of lines between blank lines and headings: ``heading``, ``body`` and how the run ended.

    A heading opens a run. A blank line, the next heading or the end of the text
    closes it; lines after a blank line and before the next heading are left out.
    ``closed_by`` is ``blank``, ``heading`` or ``end``.
    """
    keys = [c for c in df.columns if c != lines]
    arr = F.col(lines)
    marked = df.withColumn("__at", _positions(arr, is_heading)).withColumn(
        "__cut", _positions(arr, lambda s: (s == "") | is_heading(s))
    )
    found = F.transform(
        F.col("__at"),
        lambda at: F.struct(
            at.alias("at"),
            F.get(F.col("__cut"), F.array_position(F.col("__cut"), at).cast("int")).alias("cut"),
        ),
    )
    runs = marked.select(*keys, arr.alias("__lines"), F.explode(found).alias("r"))
    end = F.coalesce(F.col("r.cut"), F.size("__lines") + 1)
    return runs.select(
        *keys,
        F.col("r.at").alias("pos"),
        F.element_at("__lines", F.col("r.at")).alias("heading"),
        F.slice("__lines", F.col("r.at") + 1, end - F.col("r.at") - 1).alias("body"),
        F.when(F.col("r.cut").isNull(), F.lit("end"))
        .when(F.element_at("__lines", F.col("r.cut")) == "", F.lit("blank"))
        .otherwise(F.lit("heading"))
        .alias("closed_by"),
    )


def neighbours(
    df: DataFrame, group: list[str], pos: str, columns: dict[str, tuple[str, int]], width: int = 4096, gapless: bool = False
) -> DataFrame:
    """Add values of rows at fixed offsets in the same group.

    ``columns`` maps a new name to ``(column, offset)``; a negative offset looks back. Offsets count rows in the order
    of ``pos``, whatever gaps it has; rows without ``pos`` come first, equal ones in any order. Rows are numbered over
    range partitions and cut into blocks of ``width`` rows that repeat the few rows their edges need, so one group may
    hold any share of the rows. ``gapless`` says that ``pos`` is never NULL and counts the rows of each group one by
    one, which saves the numbering.
    """
    reach_back = max([0, *(-o for _, o in columns.values())])
    reach_on = max([0, *(o for _, o in columns.values())])
    if max(reach_back, reach_on) > width:
        raise ValueError("width must cover the largest offset")
    out = df.withColumn("__at", F.col(pos)) if gapless else numbered(df, *group, pos, name="__at")
    block, inside = F.floor(F.col("__at") / width), F.pmod("__at", F.lit(width))
    homes = F.array_compact(
        F.array(
            block,
            F.when(inside >= width - reach_back, block + 1) if reach_back else F.lit(None),
            F.when(inside < reach_on, block - 1) if reach_on else F.lit(None),
        )
    )
    # Numbers run on over all groups, so a block may hold several: neighbours of another group are blanked.
    w = Window.partitionBy(*(group if gapless else []), "__home").orderBy("__at")
    out = out.withColumn("__own", block).withColumn("__home", F.explode(homes))

    def near(column: str, offset: int) -> Column:
        at = lambda c: F.lag(c, -offset).over(w) if offset < 0 else F.lead(c, offset).over(w)
        same = F.lit(True)
        for key in group:
            same = same & at(key).eqNullSafe(F.col(key))
        return F.when(same, at(column))

    out = out.select("*", *[near(*wanted).alias(name) for name, wanted in columns.items()])
    return out.where(F.col("__home") == F.col("__own")).drop("__home", "__own", "__at")


def numbered_lines(df: DataFrame, lines: str) -> DataFrame:
    """One row per line with its 1-based position."""
    keys = [c for c in df.columns if c != lines]
    return df.select(*keys, F.posexplode(lines).alias("__i", "line")).withColumn("pos", F.col("__i") + 1).drop("__i")
