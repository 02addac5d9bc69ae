"""Diffs between snapshots and the pairing of renamed entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import model
from tessera.functions.shared import in_passes

STATE = ("origin", "confidence", "resolution")


def edge_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Added, removed and changed edges with their states before and after. Only origin, confidence and resolution make a change."""
    pick = lambda df, side: df.select("edge_key", F.struct("src", "relation", "dst").alias(f"{side}_end"), F.struct(*STATE).alias(side))
    both = pick(base, "before").join(pick(head, "after"), "edge_key", "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    end = F.coalesce("after_end", "before_end")
    return both.withColumn("change", change).where("change IS NOT NULL").select("edge_key", "change", end["src"].alias("src"), end["relation"].alias("relation"), end["dst"].alias("dst"), *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("before", "after") for c in STATE])


def named_edge_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """edge_diff of edges by the kinds and names of their ends: they meet by plain keys, a pass at a time, and digests are made of those that differ."""
    ends, sides = ["src", "relation", "dst"], (model.passing(base), model.passing(head))
    changed = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")

    def one(i: int) -> DataFrame:
        b, h = (df.where(F.col("pass") == i).select(*ends, F.struct(*STATE).alias(side)) for df, side in zip(sides, ("before", "after"), strict=True))
        return b.join(h, ends, "full_outer").withColumn("change", changed).where("change IS NOT NULL")

    rows = in_passes(one, "edge-diff")
    return rows.select(model.edge_key_of_plain().alias("edge_key"), "change", model.key_of_plain(F.col("src")).alias("src"), "relation", model.key_of_plain(F.col("dst")).alias("dst"), *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("before", "after") for c in STATE])


def key_diff(base: DataFrame, head: DataFrame, key: str, state: list[str]) -> DataFrame:
    """Added, removed and, by any of the state columns, metadata_changed keys."""
    pick = lambda df, side: df.select(key, F.struct(*state).alias(side))
    both = pick(base, "before").join(pick(head, "after"), key, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "metadata_changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(key, "change")


#: What a removed and an added node must share in either stage; the first stage asks for the trailing name, too.
NODE_KEY = ["kind", "body", "analyzer", "extractor", "extractor_version"]


def _grouped(rows: DataFrame, keys: list[str], side: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(f"{side}_n"), F.min("id").alias(f"{side}_id"))


def unique_pairs(removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Rows pair when a key without nulls has exactly one row on either side."""
    both = _grouped(removed, keys, "removed").join(_grouped(added, keys, "added"), keys)
    return both.where("removed_n = 1 AND added_n = 1").select("removed_id", "added_id")


def ambiguous_groups(removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on both sides that aren't one to one."""
    both = _grouped(removed, keys, "removed").join(_grouped(added, keys, "added"), keys)
    return both.where("removed_n > 1 OR added_n > 1").select(*keys, "removed_n", "added_n")


def rename_pairs(removed: DataFrame, added: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Stage A pairs rows equal in keys and name; stage B pairs what is left by the keys alone. Null keys never match."""
    a = unique_pairs(removed, added, [*keys, name]).withColumn("stage", F.lit("A"))
    left = removed.join(a, removed["id"] == a["removed_id"], "left_anti")
    right = added.join(a, added["id"] == a["added_id"], "left_anti")
    return a.unionByName(unique_pairs(left, right, keys).withColumn("stage", F.lit("B")))


def residual(removed: DataFrame, added: DataFrame, name: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides that stage A leaves to stage B."""
    a = unique_pairs(removed, added, [*keys, name])
    return removed.join(a, removed["id"] == a["removed_id"], "left_anti"), added.join(a, added["id"] == a["added_id"], "left_anti")


def coalesce_edges(removed: DataFrame, added: DataFrame, pairs: DataFrame) -> DataFrame:
    """Removed edges meet the added edge with the same ends after renaming; at least one end must have moved, and each edge is used once, in key order."""
    moved = pairs.select(F.col("removed_id").alias("old"), F.col("added_id").alias("new"))
    r = removed.join(moved.toDF("src", "new_src"), "src", "left").join(moved.toDF("dst", "new_dst"), "dst", "left").where("new_src IS NOT NULL OR new_dst IS NOT NULL")
    ends = ["to_src", "relation", "to_dst"]
    r = r.select(F.col("edge_key").alias("removed_edge"), F.coalesce("new_src", "src").alias("to_src"), "relation", F.coalesce("new_dst", "dst").alias("to_dst"))
    a = added.select(F.col("edge_key").alias("added_edge"), F.col("src").alias("to_src"), "relation", F.col("dst").alias("to_dst"))
    number = lambda df, key: df.withColumn("k", F.row_number().over(Window.partitionBy(*ends).orderBy(key)))
    return number(r, "removed_edge").join(number(a, "added_edge"), [*ends, "k"]).select("removed_edge", "added_edge")


def paged(parts: list[tuple[str, DataFrame]], key: str, offset: int, limit: int) -> DataFrame:
    """One page over several lists after one another, each in key order. Only rows up to the page's end are sorted."""
    tagged = None
    for i, (name, df) in enumerate(parts):
        own = df.select(F.lit(i).alias("part_no"), F.lit(name).alias("part"), F.col(key).alias("key"))
        tagged = own if tagged is None else tagged.unionByName(own)
    return tagged.orderBy("part_no", "key").offset(offset).limit(limit).select("part", "key")


def page_counts(parts: list[tuple[str, DataFrame]], offset: int, limit: int) -> DataFrame:
    """part, total, shown and omitted of each list under a page, and the next cursor (null after the last page)."""
    spark = parts[0][1].sparkSession
    totals = [df.count() for _, df in parts]
    rows, before = [], 0
    for (name, _), n in zip(parts, totals, strict=True):
        shown = max(0, min(before + n, offset + limit) - max(before, offset))
        rows.append((name, n, shown, n - shown, offset + limit if offset + limit < sum(totals) else None))
        before += n
    return spark.createDataFrame(rows, "part string, total long, shown long, omitted long, next_cursor long")
