"""Mixing sources to target weights by systematic sampling, in built-in functions only.

Within a source every document is expected `target / source_size` times. Documents stand in order of
size and id; their expected copies are prefix-summed, one offset (derived from the source and a seed) is
added, and a document is emitted once for each integer boundary its interval crosses. Ordering by size
makes the sample proportional in every size class, so the words taken come near the target.

The prefix sum is spread: counts of (source, size), then of (source, size, id block), then a row number
inside a block of `id_block` ids. No window spans a source's rows, so a hot source is dealt evenly.

Defined results: a null text has size 0; a null source is a source of its own, last in order; null ids
come first among equal sizes; equal rows are taken each on its own; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import materialize
from tessera.llm.quality import words

WEIGHTS = (5, 2, 1)


def count_words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """source, source_size -> also target: weight shares of `share` times all sizes, none over `cap` times its source's size.

    Sources reach their cap in order of size per weight: the first k are capped exactly if the rest's
    common share per weight would lift the k-th over its cap. One row a source, so one window holds them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ordered = sizes.withColumn("w", weight.cast("long"))
    ratio = [F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()]
    upto = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*ratio).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(*ratio).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lam = (share * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / F.sum("w").over(onward)
    free = ordered.withColumn("lam", lam).withColumn("over", F.col("lam") * F.col("w") >= cap * F.col("source_size"))
    level = F.min(F.when(~F.col("over"), F.struct(ratio[0].alias("r"), F.col("lam").alias("lam")))).over(every)["lam"]
    return free.select("source", "source_size", F.round(F.when(F.col("over"), cap * F.col("source_size")).otherwise(level * F.col("w")), 6).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """In [0, 1): from the source's name and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(source, F.lit("")), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, seed: int = 7, id_block: int = 4096, payload: bool = False) -> DataFrame:
    """id, source, size, source_size, target, copies; with payload also `row`, the struct of all input columns."""
    extra = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if payload else []
    base = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), count_words(docs[text_col]).alias("size"), *extra)
    base = materialize(base, "sizes")  # texts are cut into words once
    slim = base.select("id", "source", "size").withColumn("block", F.floor(F.col("id") / id_block))
    cells = slim.groupBy("source", "size", "block").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), share, cap, weights)
    ahead = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("source", "size", ahead(["source"], "size").alias("before_size"))
    cells = cells.select("source", "size", "block", ahead(["source", "size"], F.col("block").asc_nulls_first()).alias("before_block"))
    null_safe = lambda a, b, names: [a[x].eqNullSafe(b[x]) for x in names]
    cells = cells.join(sizes, null_safe(cells, sizes, ["source", "size"])).select(cells["source"], cells["size"], "block", (F.col("before_block") + F.col("before_size")).alias("before"))
    cells = cells.join(goal, cells["source"].eqNullSafe(goal["source"])).select(cells["source"], cells["size"], "block", "before", "source_size", "target")
    # one struct as key, in which nulls are equal: the window's partitions serve the join too
    cell = F.struct("source", "size", "block").alias("cell")
    cells = cells.select(cell, "before", "source_size", "target")
    ranked = base.withColumn("block", F.floor(F.col("id") / id_block)).withColumn("cell", cell).drop("block")
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy(F.col("id").asc_nulls_first())) - 1)
    out = ranked.join(cells, "cell").select(ranked["id"], ranked["source"], ranked["size"], *([ranked["row"]] if payload else []), (F.col("before") + F.col("k")).alias("rank"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = F.floor((F.col("rank") + 1) * rate + u) - F.floor(F.col("rank") * rate + u)
    return out.withColumn("copies", copies.cast("long")).drop("rank")
