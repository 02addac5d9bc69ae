"""Digests of sets of rows as trees by key prefix, and snapshots that are known by them.

A row's digest is that of its canonical JSON: all columns, nulls included, by name. Rows are dealt out by the first
hexadecimal digits of their key; a leaf's digest is that of its rows' digests in order, an inner node's that of its
children's. The number of digits follows from the number of rows unless it is given, so a leaf stays small and equal
sets have equal trees. Two snapshots are compared from the root down: where digests agree, rows are the same and aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera import model
from tessera.functions.shared import materialize, packed, shuffles_freed
from tessera.operators.diff import edge_diff, key_diff, named_edge_diff
from tessera.operators.store import NamedStore, SnapshotStore

#: Rows of a leaf, on average at most.
LEAF = 4096


def canonical(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def digits_for(n: int) -> int:
    """Digits of a leaf's prefix for n rows; at least one."""
    digits = 1
    while n > LEAF * 16**digits:
        digits += 1
    return digits


def _summed(parts: DataFrame, digits: int) -> DataFrame:
    """The nodes above, of `digits` digits; each has at most 16 children."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("prefix", "digest"))), lambda x: x["digest"])
    return parts.groupBy(F.substring("prefix", 1, digits).alias("prefix")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"), F.sum("n").alias("n"))


def _line_digests(batches):
    """leaf, line, n in order of leaf and line -> prefix, digest, n. A leaf's lines go by and are never held together."""
    leaf, sha, n = None, None, 0
    for batch in batches:
        leaves, lines, counts = (batch.column(c) for c in ("leaf", "line", "n"))
        names, done = leaves.to_numpy(zero_copy_only=False), []
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            if sha is None or names[begin] != leaf:
                if sha is not None:
                    done.append((leaf, sha.hexdigest(), n))
                leaf, sha, n = names[begin], hashlib.sha256(), 0
            else:
                sha.update(b"\n")
            sha.update("\n".join(lines.slice(begin, end - begin).to_pylist()).encode())
            n += pc.sum(counts.slice(begin, end - begin)).as_py()
        if done:
            yield _leaf_batch(done)
    if sha is not None:
        yield _leaf_batch([(leaf, sha.hexdigest(), n)])


def _leaf_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"prefix": p, "digest": d, "n": n} for p, d, n in rows], schema=pa.schema([("prefix", pa.string()), ("digest", pa.string()), ("n", pa.int64())]))


def digest_tree(rows: DataFrame, key: str, columns: list[str] | None = None, least: int = 1, digits: int | None = None, named: bool = False) -> DataFrame:
    """prefix, digest, n of every node that has rows; the root's prefix is empty. Keys are hexadecimal digests; leaves have `digits` digits or, where the number of rows decides, `least` or more. Repeated rows count each; an empty set has no rows. named: rows are edges by the names of their ends, dealt out as such; their keys are made (again) where they have come to."""
    digits = digits or max(least, digits_for(rows.count()))
    digest = lambda df: F.unhex(F.sha2(canonical(columns or df.columns), 256)).alias("digest")
    if named:
        columns = columns or model.with_edge_keys(rows).columns
        dealt = rows.withColumn("leaf", F.substring(model.named_edge_key(), 1, digits)).repartition("leaf")
        keyed = model.with_edge_keys(dealt)
        own = keyed.select("leaf", F.col(key).alias("_key"), digest(keyed))
    else:
        own = rows.select(F.substring(key, 1, digits).alias("leaf"), F.col(key).alias("_key"), digest(rows)).repartition("leaf")
    # a row that stands n times is one line with its number, so that copies don't fill a leaf
    own = own.groupBy("leaf", "_key", "digest").agg(F.count("*").alias("n")).sortWithinPartitions("leaf", "_key", "digest")
    lines = own.select("leaf", F.concat_ws(" ", "_key", F.lower(F.hex("digest")), F.col("n").cast("string")).alias("line"), "n")
    level = materialize(lines.mapInArrow(_line_digests, "prefix string, digest string, n long"), "leaves")
    tree = level
    for d in range(digits - 1, -1, -1):
        level = _summed(level, d)
        tree = tree.unionByName(level)
    return tree


def changed_prefixes(before: DataFrame, after: DataFrame, digits: int) -> DataFrame:
    """Prefixes of `digits` digits below which the two trees differ, going down only where parents differ."""
    pick = lambda t, d, name: t.where(F.length("prefix") == d).select("prefix", F.col("digest").alias(name))
    differ = None
    for d in range(digits + 1):
        both = pick(before, d, "a").join(pick(after, d, "b"), "prefix", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix")
        if differ is not None:
            both = both.withColumn("up", F.substring("prefix", 1, d - 1)).join(differ.withColumnRenamed("prefix", "up"), "up", "left_semi").select("prefix")
        differ = both
    return differ


class ContentStore(SnapshotStore):
    """Snapshots with their digest trees; nodes and edges lie in 256 folders by the first two digits of their keys. Trees of snapshots whose row numbers ask for different depths differ in all folders, which costs reading them and changes no result."""

    DIGITS = 2
    KEYS = {"nodes": "node_key", "edges": "edge_key"}

    def publish_content(self, nodes: DataFrame, edges: DataFrame, expected: int | None, workspace: str | None = None, **more: DataFrame) -> int:
        """Writes a snapshot unless one of equal content is stored, and activates it.

        Equality is by the digests of all its tables, not by a name. Where `workspace` (a hash of the files) is
        given and is known with another content, the publication is refused: one of the two is wrong.
        """
        tables = {"nodes": nodes, "edges": edges, **more}
        roots = {}
        trees = {}
        for name, df in tables.items():
            trees[name] = materialize(self._tree(name, df).withColumn("table", F.lit(name)), "tree")
            root = trees[name].where("prefix = ''").first()
            roots[name] = root["digest"] if root else ""
        content = hashlib.sha256("\n".join(f"{n} {d}" for n, d in sorted(roots.items())).encode()).hexdigest()
        known = [r["workspace_hash"] for r in self.activations().select("workspace_hash").distinct().collect()]  # a row a snapshot
        for other in known:
            if workspace and other.split(":")[0] == workspace and other.split(":")[-1] != content:
                raise ValueError("the workspace is stored with other rows; refusing to reuse its snapshot")
        name = next((x for x in known if x.split(":")[-1] == content), f"{workspace or ''}:{content}")
        every = trees["nodes"]
        for t in list(trees)[1:]:
            every = every.unionByName(trees[t])
        folder = lambda table: tables[table].withColumn("bucket", F.substring(self._key(table), 1, self.DIGITS))
        return self.publish(folder("nodes"), folder("edges"), name, expected, digests=every, **more)

    def _key(self, table: str) -> Column:
        return F.col(self.KEYS[table])

    def _tree(self, name: str, df: DataFrame) -> DataFrame:
        key = self.KEYS.get(name)
        keyed = df if key else df.withColumn("_key", F.sha2(canonical(df.columns), 256))
        return digest_tree(keyed, key or "_key", df.columns, self.DIGITS if key else 1)

    def _write(self, name: str, df: DataFrame) -> None:
        by = ["snapshot_id", "bucket"] if name in self.KEYS else ["snapshot_id"]
        # one task a folder, so that a snapshot has a file a folder and not one a task and folder
        out = df.repartition(*by) if name in self.KEYS else df
        with shuffles_freed(self.spark):
            out.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").parquet(f"{self.root}/{name}")

    def tree(self, snapshot_id: int, table: str) -> DataFrame:
        return self.read("digests", snapshot_id).where(F.col("table") == table).select("prefix", "digest", "n")

    def changed(self, table: str, base: int, head: int) -> list[str]:
        """Folders that differ: at most 256 names."""
        return sorted(r["prefix"] for r in changed_prefixes(self.tree(base, table), self.tree(head, table), self.DIGITS).collect())

    def rows(self, table: str, snapshot_id: int, buckets: list[str] | None = None) -> DataFrame:
        """A snapshot's rows, of some folders only."""
        stored = self.spark.read.parquet(f"{self.root}/{table}").schema
        # folder names are text, also where all of them look like numbers
        schema = StructType([*(f for f in stored if f.name not in ("snapshot_id", "bucket")), StructField("snapshot_id", LongType()), StructField("bucket", StringType())])
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{table}").where(F.col("snapshot_id") == snapshot_id)
        if buckets is not None:
            df = df.where(F.col("bucket").isin(buckets))
        return df.drop("snapshot_id", "bucket")

    def edge_changes(self, base: int, head: int) -> DataFrame:
        """D1's rows between two snapshots; folders with equal digests aren't read."""
        buckets = self.changed("edges", base, head)
        return edge_diff(self.rows("edges", base, buckets), self.rows("edges", head, buckets))

    def node_changes(self, base: int, head: int, state: list[str]) -> DataFrame:
        buckets = self.changed("nodes", base, head)
        return key_diff(self.rows("nodes", base, buckets), self.rows("nodes", head, buckets), "node_key", state)


class NamedContentStore(ContentStore, NamedStore):
    """Edges come, are dealt out and lie by the kinds and names of their ends, with the digests of their keyed rows: a snapshot has the trees it has in a ContentStore."""

    def _key(self, table: str) -> Column:
        return model.named_edge_key() if table == "edges" else super()._key(table)

    def _tree(self, name: str, df: DataFrame) -> DataFrame:
        return digest_tree(df, "edge_key", least=self.DIGITS, named=True) if name == "edges" else super()._tree(name, df)

    def edge_changes(self, base: int, head: int) -> DataFrame:
        """The edges meet by plain keys; digests are made of those that differ."""
        buckets = self.changed("edges", base, head)
        return named_edge_diff(self.rows("edges", base, buckets), self.rows("edges", head, buckets))


def graph_diff(base: tuple[DataFrame, DataFrame], live: tuple[DataFrame, DataFrame], state: list[str]) -> DataFrame:
    """The comparison of a served graph with a live one (nodes, edges each): a row a node or edge that differs, with `part`. Nodes: added, removed, or metadata_changed by the state columns; edges as edge_diff has them."""
    n = key_diff(base[0], live[0], "node_key", state).select(F.lit("node").alias("part"), F.col("node_key").alias("key"), "change")
    e = edge_diff(base[1], live[1]).withColumnRenamed("edge_key", "key").withColumn("part", F.lit("edge"))
    return n.unionByName(e, allowMissingColumns=True)


def named_graph_diff(base: tuple[DataFrame, DataFrame], live: tuple[DataFrame, DataFrame], state: list[str]) -> DataFrame:
    """graph_diff of nodes and edges by kinds and qualified names: both meet by plain keys, digests are made of what differs."""
    plain = lambda n: n.select(model.plain_key(F.col("kind"), F.col("qualified_name")).alias("node_key"), *state)
    n = packed(key_diff(plain(base[0]), plain(live[0]), "node_key", state), "node-diff").select(F.lit("node").alias("part"), model.key_of_plain(F.col("node_key")).alias("key"), "change")
    e = named_edge_diff(base[1], packed(live[1], "live")).withColumnRenamed("edge_key", "key").withColumn("part", F.lit("edge"))
    return n.unionByName(e, allowMissingColumns=True)


def working_tree_changes(store: ContentStore, live: tuple[DataFrame, DataFrame], **more: DataFrame) -> tuple[int, int, DataFrame]:
    """Reconciles the live graph with the store and compares: (base, head, rows). The base is the served snapshot, the head what the live graph becomes, published by its content; equal content is the same snapshot and gives no rows. Rows are in order of change, source, relation and destination."""
    before = store.head()
    after = store.publish_content(*live, before[0] if before else None, **more)
    base = before[1] if before else after
    return base, after, store.edge_changes(base, after).orderBy("change", "src", "relation", "dst")

