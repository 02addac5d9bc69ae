"""Joins of line ranges and points by dyadic buckets.

A range is cut into the fewest aligned blocks of 1, 8, 64 ... lines that make it up: at most 14 of a width. A
point lies in one block of each width, and in exactly one block of each range around it. So an equality join on
(file, width, block) gives each pair once and no other, whatever the ranges' lengths, and a file's rows are dealt
out by block instead of meeting in one task.

Rows with a null file or bound, and ranges that end before they start, match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 8


def widths_for(ranges: DataFrame, first: str, last: str) -> int:
    """How many widths the longest range needs."""
    longest, n = ranges.agg(F.max(F.col(last) - F.col(first) + 1)).first()[0] or 1, 1
    while STEP**n < longest:
        n += 1
    return n


def blocks_of(first: Column, last: Column, widths: int) -> Column:
    """The blocks (w, b) that make up a range; lines inclusive. Negative lines are fine."""
    start, end = first.cast("long"), last.cast("long") + 1
    lower = [F.ceil(start / F.lit(STEP**w)).cast("long") if w else start for w in range(widths + 1)]
    upper = [F.floor(end / F.lit(STEP**w)).cast("long") if w else end for w in range(widths + 1)]
    none = F.array().cast("array<bigint>")

    def run(a: Column, b: Column) -> Column:
        return F.when(a < b, F.sequence(a, b - 1)).otherwise(none)

    def numbered(blocks: Column, w: int) -> Column:
        return F.transform(blocks, lambda b: F.struct(F.lit(w).alias("w"), b.alias("b")))

    out = []
    for w in range(widths + 1):
        if w == widths:
            own = run(lower[w], upper[w])
        else:
            a, b = lower[w + 1] * STEP, upper[w + 1] * STEP  # what wider blocks cover
            own = F.when(a > b, run(lower[w], upper[w])).otherwise(F.concat(run(lower[w], a), run(b, upper[w])))
        out.append(numbered(own, w))
    return F.flatten(F.array(*out))


def block_around(at: Column, widths: int) -> Column:
    """The block of each width around a point."""
    return F.array(*[F.struct(F.lit(w).alias("w"), F.floor(at / F.lit(STEP**w)).cast("long").alias("b")) for w in range(widths + 1)])


def stab(points: DataFrame, at: str, ranges: DataFrame, first: str, last: str, by: str = "file") -> DataFrame:
    """Pairs of a point and a range around it, by equal `by`: all columns of both, `by` once."""
    widths = widths_for(ranges, first, last)
    left = points.withColumn("_x", F.explode(block_around(F.col(at), widths))).select("*", "_x.*").drop("_x")
    right = ranges.where(F.col(first) <= F.col(last)).withColumn("_x", F.explode(blocks_of(F.col(first), F.col(last), widths))).select("*", "_x.*").drop("_x")
    return left.join(right, [by, "w", "b"]).drop("w", "b")


def overlaps(hunks: DataFrame, spans: DataFrame) -> DataFrame:
    """hunks (file, h_start, h_end) and spans (file, node, s_start, s_end), lines inclusive: overlapping pairs, by file. Either the span's first line lies in the hunk, or the hunk's first line in the span behind its first line."""
    spans, hunks = spans.where("s_start <= s_end"), hunks.where("h_start <= h_end")
    names = [*hunks.columns, *(c for c in spans.columns if c != "file")]
    starts = stab(spans, "s_start", hunks, "h_start", "h_end").select(*names)
    inside = stab(hunks, "h_start", spans.withColumn("_after", F.col("s_start") + 1), "_after", "s_end").select(*names)
    return starts.unionByName(inside)


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The innermost span around each point (file, point, at) of its file: shortest, then first start, then node.

    All spans of a block cover all its points, so a block keeps its best span only: the join has at most a
    row a point and width, however deep spans are nested.
    """
    spans = spans.where("s_start <= s_end")
    widths = widths_for(spans, "s_start", "s_end")
    rank = F.struct((F.col("s_end") - F.col("s_start")).alias("len"), F.col("s_start"), F.col("node"))
    best = spans.select("file", rank.alias("r"), F.explode(blocks_of(F.col("s_start"), F.col("s_end"), widths)).alias("x")).groupBy("file", "x.w", "x.b").agg(F.min("r").alias("r"))
    asked = points.select("file", "point", F.explode(block_around(F.col("at"), widths)).alias("x")).select("file", "point", "x.*")
    return asked.join(best, ["file", "w", "b"]).groupBy("file", "point").agg(F.min("r").alias("r")).select("file", "point", F.col("r.node").alias("node"))
