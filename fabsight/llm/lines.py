"""Line dedup by site-relative frequency: lines that a large part of a host's pages carry are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fabsight.llm.common import durable, session

#: A line is boilerplate on more than this part of its host's pages, and on at least so many of them.
RATIO, LEAST_PAGES = 0.05, 5
#: Boilerplate lines (32 bytes each) that every task may hold; if there are more, a host's pages are dealt to so many tasks.
BROADCAST_LINES, SALTS = 1 << 20, 64


def line_key(line: Column) -> Column:
    """128 bits that stand for a line in shuffles."""
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate_lines(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, host_col: str = "source",
                      text_col: str = "text") -> DataFrame:
    """(host, line): keys of the lines on more than ``ratio`` of a host's pages and on at least ``least_pages`` of them.

    Every row is a page.  A page counts once for a line, however often it repeats it; blank lines never count.  Pages of a
    null host are pages of one host.  Counts are combined before the shuffle, so a hot host or line is a row per task.
    """
    pages = docs.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where("trim(line) <> ''")
    counts = lines.groupBy("host", line_key(F.col("line")).alias("line")).agg(F.count(F.lit(1)).alias("n"))
    c, t = counts.where(F.col("n") >= least_pages).alias("c"), totals.alias("t")
    return (c.join(t, F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("n") > F.lit(ratio) * F.col("pages"))
            .select("c.host", "c.line"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, host_col: str = "source",
                     text_col: str = "text") -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text; all columns are returned, under their names.

    Every row comes back, also one that loses all its lines (its text is empty then); a null text stays null; an empty table
    gives an empty one.  The blank and other lines keep their order.  Column names do not clash: helper columns live in
    a struct beside the row.
    """
    session(docs.sparkSession)
    # fewer than 1 / ratio lines per page can be flagged, so at most (lines of a page) / ratio per host: the list is short
    lines = durable(boilerplate_lines(docs, ratio, least_pages, host_col, text_col))
    flagged = lines.groupBy("host").agg(F.collect_list("line").alias("drop"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    host, text = F.col(f"r.row.`{host_col}`"), F.col(f"r.row.`{text_col}`")
    same = host.eqNullSafe(F.col("b.host"))
    if lines.count() <= BROADCAST_LINES:  # the texts stay where they are
        joined = row.alias("r").join(F.broadcast(flagged).alias("b"), same, "left")
    else:
        salted = row.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).alias("r")
        copies = flagged.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).alias("b")
        joined = salted.join(copies, same & (F.col("r.salt") == F.col("b.salt")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains(F.col("b.drop"), line_key(x)), F.lit(False))), "\n")
    new = F.when(F.col("b.drop").isNull(), text).otherwise(kept)
    return joined.select(*[(new if c == text_col else F.col(f"r.row.`{c}`")).alias(c) for c in docs.columns])
