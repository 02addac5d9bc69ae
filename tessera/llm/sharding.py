"""Balanced label propagation over links between documents.

Linked documents share a group (here equal texts). Labels start from a hash of the id. In each round
every group votes for the shard that holds most of it, members elsewhere ask to move there, and quotas
admit a stable share of the requests so that a shard's linked rows stay within its capacity; unlinked
rows can make way later at no cost. Groups over half a shard, at most twice as many as shards, are laid
out first, in as few and as full shards as can be. Rounds end when nothing moves. Then the counts are
made exact: shards with too many rows hand over surplus rows, unlinked ones first and then whole groups (the
last one in part), and every shard ends with the floor or ceiling of rows / shards.

Seats, draws and ranks follow from a row's id and text alone, so the way the input is split changes nothing;
node numbers only tell repeated rows apart.

Ranks inside a shard are spread: rows stand in hash buckets of about `bucket_rows`, counts of buckets are
summed, and a row number is taken only inside a bucket; so no task holds a shard.

Defined results: null texts are in no group; null ids and repeated rows are dealt like others; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import materialize


BUCKET_ROWS = 20000


def spread_rank(df: DataFrame, keys: list[str], first: list[str], deal: Column, tie: list[Column], out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df with `out`, a gapless rank from 0 within keys, ordered by `first`, a hash bucket of `deal`, then `tie`."""
    n = df.count()
    buckets = max(1, math.ceil(n / bucket_rows))
    df = df.withColumn("_bucket", F.pmod(deal, F.lit(buckets)))
    cell = [*keys, *first, "_bucket"]
    counts = df.groupBy(*cell).agg(F.count("*").alias("_n"))
    order = [*first, "_bucket"]
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*cell, before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(*tie)) - 1
    return df.withColumn("_in", inside).join(counts, cell).withColumn(out, F.col("_before") + F.col("_in")).drop("_bucket", "_in", "_before")


def _loads(df: DataFrame, shards: int) -> list[int]:
    got = {r[0]: r[1] for r in df.groupBy("shard").agg(F.count("*")).collect()}  # a row a shard
    return [got.get(s, 0) for s in range(shards)]


def _lay_out(big: list[tuple[str, int]], capacity: int, shards: int) -> list[tuple[str, float, int]]:
    """(group, upper share, shard) chunks of the groups too large to be moved as one: the largest first, into the roomiest shards."""
    room, out = [capacity] * shards, []
    for group, size in sorted(big, key=lambda x: (-x[1], x[0])):
        placed = 0
        while placed < size:
            s = max(range(shards), key=lambda i: (room[i], -i))
            take = min(size - placed, room[s]) if room[s] > 0 else size - placed
            placed, room[s] = placed + take, room[s] - take
            out.append((group, placed / size, s))
    return out


def propagate(nodes: DataFrame, shards: int, rounds: int = 6) -> DataFrame:
    """nodes: id, nid (unique), own (hash of id and text), grp (null: unlinked). Adds link (null: unlinked), part (a large link's rows in parts) and shard after balanced label propagation. Only linked rows take part in the rounds."""
    capacity = max(1, nodes.count() // shards)
    part = max(1, capacity // 2)
    sizes = nodes.where("grp IS NOT NULL").groupBy("grp").agg(F.count("*").alias("size")).where("size > 1")
    sizes = materialize(sizes, "sizes")  # its join has exchanges of its own, so a hot group can be split
    big = [tuple(r) for r in sizes.where(F.col("size") > part).collect()]  # under 2 * shards + shards groups
    apart = nodes.withColumn("grp", F.coalesce("grp", F.concat(F.lit("none "), F.col("nid").cast("string"))))  # no hot null key
    share = F.pmod(F.xxhash64("own", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    seat = F.pmod(F.xxhash64("own", F.lit(17)), F.lit(shards)).cast("int")
    chunk = F.lit(0)
    for i, (group, upto, s) in reversed(list(enumerate(_lay_out(big, capacity, shards)))):
        mine = (F.col("grp") == group) & (share < upto)
        seat, chunk = F.when(mine, s).otherwise(seat), F.when(mine, i).otherwise(chunk)
    state = apart.join(sizes, "grp", "left").withColumns({"link": F.when(F.col("size").isNotNull(), F.xxhash64("grp", chunk)), "part": F.when(F.col("size") > BUCKET_ROWS, F.pmod(F.xxhash64("own", F.lit(29)), F.ceil(F.col("size") / BUCKET_ROWS))).otherwise(0).cast("int"), "shard": seat.cast("int")}).drop("grp", "size")
    state = materialize(state, "labels")
    alone, linked = state.where("link IS NULL"), state.where("link IS NOT NULL")
    for turn in range(rounds):
        votes = linked.groupBy("link", "shard").agg(F.count("*").alias("votes"))
        votes = materialize(votes, "votes")
        wish = votes.groupBy("link").agg(F.max(F.struct("votes", F.xxhash64("link", "shard", F.lit(turn)).alias("tie"), "shard"))["shard"].alias("to"))
        wish = materialize(wish, "wish")  # its join has exchanges of its own, so a hot link can be split
        flows = {(r[0], r[1]): r[2] for r in votes.join(wish, "link").groupBy("shard", "to").agg(F.sum("votes")).collect()}  # at most shards squared
        load = [sum(v for (a, _), v in flows.items() if a == s) for s in range(shards)]
        asks = {k: v for k, v in flows.items() if k[0] != k[1]}
        if not asks:
            break
        leave = [sum(v for (a, _), v in asks.items() if a == s) for s in range(shards)]
        come = [sum(v for (_, b), v in asks.items() if b == s) for s in range(shards)]
        quota = [1.0 if not come[s] else max(0.0, min(1.0, (capacity - load[s] + leave[s]) / come[s])) for s in range(shards)]
        limit = F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("to") + 1)
        draw = F.pmod(F.xxhash64("link", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        linked = linked.join(wish, "link").withColumn("shard", F.when(draw < limit, F.col("to")).otherwise(F.col("shard"))).drop("to")
        linked = materialize(linked, "labels")
    return alone.unionByName(linked)


def even_out(state: DataFrame, shards: int) -> DataFrame:
    """Moves just as many rows as needed for counts at most one apart, unlinked rows first."""
    load = _loads(state, shards)
    total = sum(load)
    by_load = sorted(range(shards), key=lambda s: (-load[s], s))
    goal = {s: total // shards + (i < total % shards) for i, s in enumerate(by_load)}
    surplus = [max(0, load[s] - goal[s]) for s in range(shards)]
    if not any(surplus):
        return state
    # groups stand together, so that they move whole; a group of many rows is ranked in parts
    rows = state.withColumn("_held", F.when(F.col("link").isNull(), 0).when(F.col("part") == 0, 1).otherwise(2))
    rows = rows.withColumn("_deal", F.coalesce("link", "own"))
    ranked = spread_rank(rows, ["shard"], ["_held", "part"], F.xxhash64("_deal"), [F.col("_deal"), F.col("own"), F.col("nid")], "_rank").drop("_deal")
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("shard") + 1)
    starts = [sum(surplus[:s]) for s in range(shards)]
    turn = pick(starts) + F.col("_rank")
    new, at = F.col("shard"), 0
    for s in range(shards):
        if (room := goal[s] - load[s]) > 0:
            new = F.when((F.col("_rank") < pick(surplus)) & (turn >= at) & (turn < at + room), F.lit(s)).otherwise(new)
            at += room
    return ranked.withColumn("shard", new.cast("int")).drop("_rank", "_held")


def cut_share(dealt: DataFrame) -> DataFrame:
    """Of rows (grp, shard): linked rows, and those outside the shard that holds most of their group: the cut of a star of links around it."""
    votes = dealt.where("grp IS NOT NULL").groupBy("grp", "shard").agg(F.count("*").alias("n"))
    return votes.groupBy("grp").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1").agg(F.sum("n").alias("linked"), F.sum(F.col("n") - F.col("most")).alias("cut"))


def with_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", name: str = "shard") -> DataFrame:
    """docs with a shard column. Rows find their shard by id and text; of rows equal in both, each shard takes as many as it was dealt."""
    key = lambda i: F.struct(i.alias("i"), F.col("grp").alias("g")).alias("key")
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("id"), F.substring(F.sha2(docs[text_col], 256), 1, 32).alias("grp")).select("row", key(F.col("id")))
    left = own.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))))
    dealt = assign_shards(docs, shards, id_col, text_col, groups=True).select(key(F.col("id")), "shard").groupBy("key", "shard").agg(F.count("*").alias("n"))
    upto = dealt.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("shard")))
    right = upto.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("places"))  # an entry a shard at most
    both = left.join(right, "key").withColumn("to", F.get(F.filter("places", lambda x: x["upto"] >= F.col("k")), F.lit(0))["shard"])
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != name], F.col("to").alias(name))


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rounds: int = 6, groups: bool = False) -> DataFrame:
    """id, size (UTF-8 bytes plus 1), text_crc32 (0 for null), shard, slot (gapless from 0 in a shard); counts of rows at most one apart."""
    text = docs[text_col]
    base = docs.select(docs[id_col].alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), F.when(text.isNotNull(), F.substring(F.sha2(text, 256), 1, 32)).alias("grp"))
    # a node number that is unique as long as the file stands: repeated rows are numbered apart
    nodes = materialize(base.withColumns({"nid": F.monotonically_increasing_id(), "own": F.xxhash64(F.col("id").cast("string"), "grp")}), "nodes")
    state = materialize(even_out(propagate(nodes, shards, rounds), shards), "shards")
    if groups:
        return nodes.select("nid", "id", "grp").join(state.select("nid", "shard"), "nid").select("id", "grp", "shard")
    slots = spread_rank(state, ["shard"], [], F.xxhash64("own", F.lit(3)), [F.col("own"), F.col("id"), F.col("nid")], "slot")
    return slots.select("id", (F.col("bytes") + 1).alias("size"), F.col("crc").alias("text_crc32"), "shard", "slot")
