"""What one entity, one comparison or one refresh shows to a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import model
from tessera.functions.shared import materialize, packed
from tessera.operators.diff import key_diff

WIRE_NODE = {"entityKey": "node_key", "kind": "kind", "qualifiedName": "qualified_name", "displayName": "display_name", "file": "file", "packageName": "package", "language": "language"}
WIRE_EDGE = {"entityKey": "edge_key", "src": "src", "relation": "relation", "dst": "dst", "origin": "origin", "confidence": "confidence", "resolution": "resolution"}


def wire(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows as a reader's protocol names them; columns a table lacks are null."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(n) for n, c in names.items()])


def filter_nodes(nodes: DataFrame, kinds=None, package: str | None = None, file: str | None = None, prefix: str | None = None, exported: bool | None = None) -> DataFrame:
    """Nodes of the kinds, package and file; prefix: of the qualified name. What is None isn't asked. Filters reach the scan."""
    for test, value in ((F.col("kind").isin(*(kinds or ())), kinds), (F.col("package") == package, package), (F.col("file") == file, file), (F.startswith("qualified_name", F.lit(prefix)), prefix), (F.col("exported") == exported if exported is not None else None, exported)):
        nodes = nodes if value is None else nodes.where(test)
    return nodes


def filter_edges(edges: DataFrame, relations=None, origins=None, confidences=None, resolutions=None) -> DataFrame:
    for column, values in (("relation", relations), ("origin", origins), ("confidence", confidences), ("resolution", resolutions)):
        edges = edges if values is None else edges.where(F.col(column).isin(*values))
    return edges


def resolve_entity(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (query) -> query, status (ok, ambiguous, unknown), node_key, n_candidates. An entity key comes before a qualified name, that before a display name; several of the best are ambiguous."""
    names = nodes.select("node_key", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(c).alias("query")) for r, c in enumerate(("node_key", "qualified_name", "display_name"))])).alias("x")).select("node_key", "x.*")
    hit = wanted.select("query").distinct().join(names, "query").groupBy("query", "rank").agg(F.count("*").alias("n"), F.min("node_key").alias("one"))
    best = hit.groupBy("query").agg(F.min(F.struct("rank", "n", "one")).alias("b")).select("query", "b.n", "b.one")
    rows = wanted.select("query").distinct().join(best, "query", "left")
    status = F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return rows.select("query", status.alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("node_key"), F.coalesce("n", F.lit(0)).alias("n_candidates"))


def node_detail(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, status, node_key, direction (out, in), edge_key, relation, other: the edges (keyed, or by plain keys) at each resolved entity, and its fan_in; a row without an edge where there is none."""
    # the size of what is written is known: few names go to the nodes and edges, not these to them
    asked = packed(resolve_entity(nodes, materialize(wanted.select("query").distinct(), "wanted")), "asked")
    edge, digest = model.keys_of(edges)
    end_key = F.col("node_key") if "edge_key" in edges.columns else model.plain_key(F.col("kind"), F.col("qualified_name"))
    key = packed(nodes.join(asked.select("node_key").distinct(), "node_key").select("node_key", end_key.alias("end")).distinct(), "ends")
    end = lambda here, there, name: edges.join(key.toDF("node_key", here), here).select("node_key", F.lit(name).alias("direction"), edge.alias("edge_key"), "relation", digest(F.col(there)).alias("other"))
    both = packed(end("src", "dst", "out").unionByName(end("dst", "src", "in")), "at-node")
    fan = both.where((F.col("direction") == "in") & F.col("relation").isin(*model.FAN_IN_RELATIONS)).groupBy("node_key").agg(F.count("*").alias("fan_in"))
    return asked.join(both, "node_key", "left").join(fan, "node_key", "left").select("query", "status", "node_key", "direction", "edge_key", "relation", "other", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def top_labels(nodes: DataFrame, weight: Column, by: str, most: int) -> DataFrame:
    """The `most` heaviest nodes of each group, then by name and key: what bears a label in a crowded view. Groups are cut before they are sorted, in parts."""
    rows = nodes.select(by, "node_key", "display_name", weight.alias("weight"))
    order = [F.desc("weight"), F.asc("display_name"), F.asc("node_key")]
    part = rows.withColumn("part", F.pmod(F.xxhash64("node_key"), F.lit(64)))
    some = part.withColumn("k", F.row_number().over(Window.partitionBy(by, "part").orderBy(*order))).where(F.col("k") <= most)
    return some.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("position") <= most).select(by, "position", "node_key", "weight")


def working_tree_diff(head: DataFrame, index: DataFrame, worktree: DataFrame) -> DataFrame:
    """path, staged and unstaged change (added, removed, modified, null): head against index, index against working tree (path, hash each); a path in the tree alone is untracked."""
    change = lambda a, b, name: key_diff(a, b, "path", ["hash"]).select("path", F.when(F.col("change") == "metadata_changed", "modified").otherwise(F.col("change")).alias(name))
    rows = change(head, index, "staged").join(change(index, worktree, "unstaged"), "path", "full_outer")
    known = head.select("path").union(index.select("path")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, "path", "left")
    return rows.select("path", "staged", F.when((F.col("unstaged") == "added") & F.col("known").isNull(), "untracked").otherwise(F.col("unstaged")).alias("unstaged"))


def live_comparison(base: DataFrame, live: DataFrame, renamed: DataFrame) -> DataFrame:
    """path, status of a live tree against a snapshot (path, hash each): unchanged, modified, added, removed, or renamed where pairs (removed_id, added_id) say so, with the old path."""
    rows = base.select("path", F.col("hash").alias("b")).join(live.select("path", F.col("hash").alias("l")), "path", "full_outer")
    rows = rows.join(renamed.select(F.col("added_id").alias("path"), F.col("removed_id").alias("old_path")), "path", "left").join(renamed.select(F.col("removed_id").alias("path"), F.lit(True).alias("moved")), "path", "left")
    status = F.when(F.col("old_path").isNotNull(), "renamed").when(F.col("b").isNull(), "added").when(F.col("l").isNull(), "removed").when(F.col("b") == F.col("l"), "unchanged").otherwise("modified")
    return rows.where("moved IS NULL").select("path", "old_path", status.alias("status"))


def refresh_states(events: DataFrame, by: str) -> DataFrame:
    """The state after each event (by, seq, generation, kind: change, start, done, fail) of a refresh loop: dirty, running, settled, error or obsolete.

    A change makes it dirty with its generation; what a start, done or fail of an older generation than the
    newest change reports is obsolete and leaves the state dirty.
    """
    w = Window.partitionBy(by).orderBy("seq")
    newest = F.max(F.when(F.col("kind") == "change", F.col("generation"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("newest", newest)
    own = F.when(F.col("kind") == "change", "dirty").when(F.col("generation") < F.col("newest"), "obsolete").when(F.col("kind") == "start", "running").when(F.col("kind") == "done", "settled").otherwise("error")
    return rows.select(by, "seq", "generation", "kind", own.alias("state"))


def rotations(activations: DataFrame, attempts: DataFrame, by: str) -> DataFrame:
    """Events of a rotating head, in order of seq: replaced for an activation (by, seq, snapshot_id) with the one before, pending while an attempt (by, seq, outcome) has none, error where it failed, settled where it ended well."""
    w = Window.partitionBy(by).orderBy("seq")
    turned = activations.select(by, "seq", F.when(F.lag("snapshot_id").over(w).isNull(), "settled").when(F.lag("snapshot_id").over(w) == F.col("snapshot_id"), "settled").otherwise("replaced").alias("event"), F.lag("snapshot_id").over(w).alias("previous"))
    tried = attempts.select(by, "seq", F.when(F.col("outcome").isNull(), "pending").when(F.col("outcome") == "failed", "error").otherwise("settled").alias("event"), F.lit(None).cast("long").alias("previous"))
    return turned.unionByName(tried)
