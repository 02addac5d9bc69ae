"""Snapshots in Parquet: publish, head, freshness, pruning and collection of what nothing refers to.

Layout under one root: nodes/, edges/ and files/ partitioned by snapshot_id, and an append-only
activations/ log, whose rows are the commit markers: a snapshot without one was never published.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera import model
from tessera.functions.shared import in_passes, materialize, packed, shuffles_freed
from tessera.sources.captures import normalized

FRESHNESS = "CASE WHEN live_hash IS NULL AND stored_hash IS NULL THEN 'unknown' WHEN live_hash IS NULL THEN 'stale' WHEN stored_hash IS NULL THEN 'unknown' WHEN live_hash = stored_hash THEN 'fresh' ELSE 'stale' END"


class Conflict(RuntimeError):
    """The head isn't the one the writer started from."""


class SnapshotStore:
    ACTIVATION = "activation_id long, snapshot_id long, workspace_hash string, previous long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def activations(self) -> DataFrame:
        path = f"{self.root}/activations"
        hadoop, fs = self._fs(path)
        if not fs.exists(hadoop):
            return self.spark.createDataFrame([], self.ACTIVATION)
        return self.spark.read.schema(self.ACTIVATION).json(path)

    def _activate(self, row: dict) -> None:
        """A file named by the activation's number, which only one writer can create: of two that saw the same head, one fails."""
        hadoop, fs = self._fs(f"{self.root}/activations/{row['activation_id']:012d}.json")
        try:
            out = fs.create(hadoop, False)
        except Exception as error:
            raise Conflict(f"activation {row['activation_id']} was taken by another writer") from error
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def head(self) -> tuple[int, int] | None:
        """(activation id, snapshot id) of the newest activation."""
        row = self.activations().orderBy(F.desc("activation_id")).first()
        return (row["activation_id"], row["snapshot_id"]) if row else None

    def read(self, table: str, snapshot_id: int, schema: StructType | None = None) -> DataFrame:
        """A snapshot's rows; the partition filter prunes all other snapshots' files. A schema is needed only where a table may have no rows at all."""
        reader = self.spark.read.schema(StructType([*schema, StructField("snapshot_id", LongType())])) if schema else self.spark.read
        return reader.parquet(f"{self.root}/{table}").where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")

    def publish(self, nodes: DataFrame, edges: DataFrame, workspace_hash: str, expected: int | None, **more: DataFrame) -> int:
        """Writes a snapshot and activates it if the head's activation id still is `expected`.

        Equal workspace hashes reuse the stored snapshot and only append an activation. Dangling edges
        refuse the snapshot; the previous head stays. More tables (files, evidence, diagnostics, projects) are stored likewise.
        """
        log = self.activations()
        old = log.where(F.col("workspace_hash") == workspace_hash).orderBy(F.desc("activation_id")).first()
        snapshot = old["snapshot_id"] if old else (log.agg(F.max("snapshot_id")).first()[0] or 0) + 1
        if not old:
            for name, df in {"nodes": nodes, "edges": edges, **more}.items():
                self._write(name, df.withColumn("snapshot_id", F.lit(snapshot)))
            # what is written is checked, not computed again; without an activation it isn't published
            if not self._loose(snapshot, nodes.schema, edges.schema).isEmpty():
                raise ValueError("dangling edges")
        now = self.head()
        if (now[0] if now else None) != expected:
            raise Conflict(f"head is {now}, expected activation {expected}")
        self._activate({"activation_id": (now[0] if now else 0) + 1, "snapshot_id": snapshot, "workspace_hash": workspace_hash, "previous": now[1] if now else None})
        return snapshot

    def _loose(self, snapshot: int, nodes: StructType, edges: StructType) -> DataFrame:
        """What stands at the end of a written edge and is no written node."""
        return model.dangling(self.read("edges", snapshot, edges), self.read("nodes", snapshot, nodes))

    def _write(self, name: str, df: DataFrame) -> None:
        with shuffles_freed(self.spark):
            df.write.partitionBy("snapshot_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(f"{self.root}/{name}")

    def prune(self, snapshot_id: int, pinned: tuple[int, ...] = (), active: tuple[int, ...] = ()) -> None:
        """Drops a snapshot's memberships; the head, pinned ones and those of active tasks are refused. Activation rows stay."""
        if snapshot_id in pinned or (self.head() or (0, None))[1] == snapshot_id:
            raise ValueError("pinned or active")
        if snapshot_id in active:
            raise ValueError("an active task reads it")
        root, fs = self._fs(self.root)
        for table in [x.getPath().getName() for x in fs.listStatus(root)]:
            if table != "activations":
                fs.delete(self._fs(f"{self.root}/{table}/snapshot_id={snapshot_id}")[0], True)


class NamedStore(SnapshotStore):
    """A store of edges by the kinds and qualified names of their ends, as model.with_edge_keys takes them.

    Digests don't compress and names do, so an edge's three keys aren't written but derived when it is read; ends are checked by name.
    """

    def read(self, table: str, snapshot_id: int, schema: StructType | None = None) -> DataFrame:
        df = super().read(table, snapshot_id, schema)
        return model.with_edge_keys(df) if table == "edges" else df

    def read_named(self, snapshot_id: int) -> DataFrame:
        return super().read("edges", snapshot_id)

    def read_plain(self, snapshot_id: int) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges with plain keys (model.plain_key), where only equality of ends counts."""
        n = super().read("nodes", snapshot_id).withColumn("node_key", model.plain_key(F.col("kind"), F.col("qualified_name")))
        return n, model.plain_ends(super().read("edges", snapshot_id))

    def _loose(self, snapshot: int, nodes: StructType, edges: StructType) -> DataFrame:
        e = super().read("edges", snapshot, edges)
        ends = e.select(F.col("src_kind").alias("kind"), F.col("src_name").alias("qualified_name")).union(e.select("dst_kind", "dst_name")).distinct()
        return ends.join(super().read("nodes", snapshot, nodes).select("kind", "qualified_name"), ["kind", "qualified_name"], "left_anti")


def newest_valid(activations: DataFrame, broken: DataFrame, by: list[str]) -> DataFrame:
    """Per group the newest activation whose snapshot isn't among the broken ones."""
    ok = activations.join(broken.select("snapshot_id").distinct(), "snapshot_id", "left_anti")
    return ok.groupBy(*by).agg(F.max(F.struct("activation_id", "snapshot_id")).alias("h")).select(*by, "h.activation_id", "h.snapshot_id")


def orphans(entities: DataFrame, key: str, *members: DataFrame) -> DataFrame:
    """Entities that no membership refers to."""
    for m in members:
        entities = entities.join(m.select(F.col(m.columns[0]).alias(key)), key, "left_anti")
    return entities


def retained(events: DataFrame, done: DataFrame, cutoff: str) -> DataFrame:
    """Events that stay: those not older than the cutoff, and all of tasks that aren't done."""
    old = events.where(F.col("ts") < F.lit(cutoff).cast("timestamp"))
    return events.where(~(F.col("ts") < F.lit(cutoff).cast("timestamp")) | F.col("ts").isNull()).unionByName(old.join(done.select("task"), "task", "left_anti"))


def freshness(stored: DataFrame, live: DataFrame) -> DataFrame:
    """path, hash of both sides -> path, freshness."""
    both = stored.select("path", F.col("hash").alias("stored_hash")).join(live.select("path", F.col("hash").alias("live_hash")), "path", "full_outer")
    return both.select("path", F.expr(FRESHNESS).alias("freshness"))


def worst_freshness(files: DataFrame, of: DataFrame, by: str) -> DataFrame:
    """The worst of the files (path, freshness) each entity (by, path) depends on: stale, then unknown, then fresh."""
    rank = F.expr("CASE freshness WHEN 'stale' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END")
    return of.join(files, "path", "left").groupBy(by).agg(F.max(F.coalesce(rank, F.lit(1))).alias("r")).select(by, F.get(F.array(F.lit("fresh"), F.lit("unknown"), F.lit("stale")), F.col("r")).alias("freshness"))


def freshness_reasons(wanted: DataFrame, stored: DataFrame, live: DataFrame, pending: DataFrame) -> DataFrame:
    """wanted (path), stored and live (path, hash; a live file that can't be read has none), pending (path) -> path, status, reason. What is asked first decides: not in the snapshot, a refresh pending, outside the root, unreadable, changed, the same."""
    rows = wanted.select("path").distinct().join(stored.select("path", F.col("hash").alias("s")), "path", "left").join(live.select("path", F.col("hash").alias("l")), "path", "left")
    rows = rows.join(pending.select("path", F.lit(True).alias("p")).distinct(), "path", "left")
    reason = (
        F.when(F.col("s").isNull(), "not_in_snapshot").when(F.col("p"), "refresh_pending").when(normalized(F.col("path")).isNull(), "outside_repository")
        .when(F.col("l").isNull(), "unreadable").when(F.col("s") != F.col("l"), "content_changed").otherwise("matches_snapshot")
    )
    status = F.when(F.col("reason").isin("refresh_pending", "content_changed"), "stale").when(F.col("reason") == "matches_snapshot", "fresh").otherwise("unknown")
    return rows.withColumn("reason", reason).select("path", status.alias("status"), "reason")


def orphan_chain(edges: DataFrame, nodes: DataFrame, files: DataFrame, member_edges: DataFrame, member_nodes: DataFrame, member_files: DataFrame, key: Sequence[str] = ("edge_key",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edge, node and file entities to collect, in this order: an edge (edge_key, src, dst) without membership; a node (node_key, file) without one that no remaining edge has as an end; a file without one that no remaining node is in. key: the columns that tell edges apart."""
    keys = [*key, "pass"]
    held = model.with_pass(member_edges, *key).select(*keys).distinct().withColumn("held", F.lit(True))
    every = model.with_pass(edges, *key)
    marked = in_passes(lambda i: every.where(F.col("pass") == i).join(held, keys, "left"), "marked")
    gone = marked.where("held IS NULL").select(*[c for c in edges.columns if c != "pass"])
    ends = packed(marked.where("held").select(F.explode(F.array("src", "dst")).alias("node_key")).distinct(), "ends")
    loose = packed(orphans(nodes, "node_key", member_nodes.select("node_key"), ends), "loose")
    kept = nodes.join(loose.select("node_key"), "node_key", "left_anti")
    return gone, loose, orphans(files, "file", member_files.select("file"), kept.select("file"))


#: What a region's files declare; a change of these keys isn't regional.
DECLARATION_KINDS = ("function", "method", "class", "interface", "type", "route", "test")


def region_faults(before: DataFrame, replacement: DataFrame, invalidated: DataFrame, nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """key, fault of a replacement that can't be merged. before, replacement: path, language; invalidated: path; nodes have node_key, kind, file."""
    fault = lambda df, key, what: df.select(F.col(key).cast("string").alias("key"), F.lit(what).alias("fault"))
    paths = invalidated.select("path")
    out = fault(paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "path", "invalidated twice")
    out = out.union(fault(paths.join(replacement, "path", "left_anti").distinct(), "path", "missing replacement")).union(fault(replacement.join(paths, "path", "left_anti"), "path", "unexpected replacement"))
    out = out.union(fault(paths.join(before, "path", "left_anti").distinct(), "path", "not in the previous graph"))
    out = out.union(fault(replacement.join(before.select("path", F.col("language").alias("was")), "path").where(~F.col("language").eqNullSafe(F.col("was"))), "path", "language changed"))
    declares = lambda df: df.where(F.col("kind").isin(*DECLARATION_KINDS)).join(paths.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select("node_key")
    old, new = declares(nodes), declares(new_nodes)
    return out.union(fault(old.join(new, "node_key", "left_anti"), "node_key", "declaration gone")).union(fault(new.join(old, "node_key", "left_anti"), "node_key", "declaration added"))


def workspace_hash(files: DataFrame, by: list[str]) -> DataFrame:
    """SHA-256 of the sorted `path NUL hash` lines of each workspace. A line is 64 bytes and a path, so a workspace's lines fit one value; many workspaces are dealt out."""
    line = F.concat(F.col("path"), F.lit("\0"), F.col("hash"))
    return files.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("workspace_hash"), F.count("*").alias("n_files"))


def stable_upsert(known: DataFrame, incoming: DataFrame, key: str, identity: str) -> DataFrame:
    """Known entities and new ones; a new identity whose key is taken gets the hash of `identity|n`, n counting from 1."""
    fresh = incoming.join(known.select(identity), identity, "left_anti").dropDuplicates([identity])
    taken = known.groupBy(key).agg(F.count("*").alias("_taken"))
    w = Window.partitionBy(key).orderBy(identity)
    number = F.row_number().over(w) - 1 + F.coalesce("_taken", F.lit(0))
    placed = fresh.join(taken, key, "left").withColumn("collision_index", number.cast("int"))
    new_key = F.when(F.col("collision_index") == 0, F.col(key)).otherwise(F.sha2(F.concat_ws("|", F.col(identity), F.col("collision_index").cast("string")), 256))
    placed = placed.withColumn(key, new_key).drop("_taken")
    return known.withColumn("collision_index", F.lit(0)).unionByName(placed) if "collision_index" not in known.columns else known.unionByName(placed)


def _merged_edges(nodes: DataFrame, edges: DataFrame, new_edges: DataFrame, files: DataFrame) -> DataFrame:
    """The edges of merge_region with their passes."""
    gone = packed(nodes.join(files, "file", "left_semi").select(F.col("node_key").alias("src")), "gone")
    ends = ["src", "relation", "dst"]
    columns = [*ends, "origin", "confidence", "resolution", "pass"]
    left = model.with_pass(edges, *ends).join(gone, "src", "left_anti").select(*columns).unionByName(model.with_pass(new_edges, *ends).select(*columns))
    return in_passes(lambda i: model.strongest_claims(left.where(F.col("pass") == i), [*ends, "pass"]).drop("n_claims").select(*columns), "merged-edges")


def merge_region(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges are keyed, or by plain keys. A snapshot with the rows of the invalidated files (file) replaced. Edges go with their source's file; duplicates keep the strongest claim; external nodes that nothing refers to go."""
    kept = nodes.join(files, "file", "left_anti")
    merged = kept.unionByName(new_nodes.select(*nodes.columns))
    best = _merged_edges(nodes, edges, new_edges, files)
    best = best if "pass" in edges.columns else best.drop("pass")
    key = model.edge_key(F.col("src"), F.col("relation"), F.col("dst")) if "edge_key" in edges.columns else model.edge_key_of_plain()
    best = best.select(key.alias("edge_key"), *best.columns)
    used = best.select(F.explode(F.array("src", "dst")).alias("node_key")).distinct()
    external = merged.where("kind = 'external_dep'").join(used, "node_key", "left_anti").select("node_key")
    return merged.join(external, "node_key", "left_anti"), best


class UnsafeMerge(ValueError):
    """A region can't be replaced by itself: a full build is needed."""


def replace_region(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, new_evidence: DataFrame, invalidated: DataFrame, key: Sequence[str] = ("edge_key",), fold: Callable[[DataFrame], DataFrame] = lambda proof: proof) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and evidence of a snapshot with a region (invalidated: path) replaced, or UnsafeMerge where that isn't safe.

    An edge goes with its source's file, and when any of its evidence (edge_key, file and more columns) is of an
    invalidated file, whatever file its source is in. A new node that is still there by its key stays as it was.
    The replacement must have the region's files, languages and declarations (region_faults), and every end of
    a merged edge must be a node. Evidence of edges that are gone goes too. An empty region is not safe either.
    key: the columns by which evidence names its edge, the ends and relation for plain keys. fold: what is kept of
    each pass's evidence in its place, for those who don't want the rows.
    """
    paths = materialize(invalidated.select("path"), "invalidated")
    if paths.isEmpty():
        raise UnsafeMerge("no file is invalidated")
    captured = lambda df: df.where("kind = 'file'").select(F.col("file").alias("path"), "language")
    faults = region_faults(captured(nodes), captured(new_nodes), paths, nodes, new_nodes).limit(5).collect()
    if faults:
        raise UnsafeMerge("; ".join(f"{r['fault']}: {r['key']}" for r in faults))
    files = paths.select(F.col("path").alias("file"))
    keys = [*key, "pass"]
    columns = evidence.columns
    edges, new_edges, evidence, new_evidence = (model.with_pass(df, *key) for df in (edges, new_edges, evidence, new_evidence))
    stale = evidence.join(files, "file", "left_semi").select(*keys).distinct()
    kept = nodes.join(files, "file", "left_anti").select("node_key")
    left, own = edges.join(stale, keys, "left_anti"), "edge_key" in key
    if own:  # edges meet by their ends, whatever key they came with
        left, new_edges = left.drop("pass"), new_edges.drop("pass")
    merged, best = merge_region(nodes, left, new_nodes.join(kept, "node_key", "left_anti"), new_edges, files)
    best = model.with_pass(best, "edge_key") if own else best
    merged = packed(merged, "merged-nodes")
    ends = packed(best.select(F.explode(F.array("src", "dst")).alias("node_key")).distinct().join(merged.select("node_key"), "node_key", "left_anti"), "loose")
    if not ends.isEmpty():
        loose = best.join(ends.toDF("src"), "src", "left_semi").unionByName(best.join(ends.toDF("dst"), "dst", "left_semi")).select("edge_key").limit(5).collect()
        raise UnsafeMerge("ends outside the merged nodes: " + ", ".join(r["edge_key"] for r in loose))
    old = evidence.join(files, "file", "left_anti").join(stale, keys, "left_anti")
    proof = old.unionByName(new_evidence.select(*old.columns)).distinct().join(best.select(*keys), keys, "left_semi")
    return merged, best.drop("pass"), in_passes(lambda i: fold(proof.where(F.col("pass") == i).select(*columns)), "evidence")
