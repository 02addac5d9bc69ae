"""The driver's tables as a code graph: regions and nations are packages, customers and suppliers files, orders methods or tests, parts functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model
from tessera.functions.shared import shared_dir
from tessera.operators.store import Conflict, NamedStore

BASE, HEAD = "base", "head"
#: Orders of a snapshot: base ends before 2001, head starts in 1996.
WINDOW = {BASE: "o_orderdate < TIMESTAMP '2001-01-01'", HEAD: "o_orderdate >= TIMESTAMP '1996-01-01'"}
CERTAIN = {BASE: "l_returnflag = 'R'", HEAD: "l_returnflag = 'R' OR l_linenumber = 1"}
NODE_COLUMNS = ("node_key", "kind", "qualified_name", "display_name", "file", "package", "language")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, kind, qualified, display, file=None, package=None, language=None) -> DataFrame:
    text = lambda x: F.lit(None).cast("string") if x is None else x
    return df.select(model.node_key(kind, qualified).alias("node_key"), kind.alias("kind"), qualified.alias("qualified_name"), display.alias("display_name"), text(file).alias("file"), text(package).alias("package"), text(language).alias("language"))


def _name(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, snapshot: str = HEAD) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").select("n_nationkey", "n_name")
    customer = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    orders = t("orders").where(WINDOW[snapshot]).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "test").otherwise("method")
    return (
        _node(t("region"), F.lit("package"), _name("region:", "r_name"), F.col("r_name"))
        .union(_node(t("nation"), F.lit("package"), _name("nation:", "n_name"), F.col("n_name")))
        .union(_node(customer, F.lit("file"), _name("c/", "c_custkey"), F.col("c_name"), _name("c/", "c_custkey"), F.col("n_name"), F.col("c_mktsegment")))
        .union(_node(supplier, F.lit("file"), _name("s/", "s_suppkey"), F.col("s_name"), _name("s/", "s_suppkey"), F.col("n_name"), F.lit("SUPPLY")))
        .union(_node(orders, kind, _name("order:", "o_orderkey"), _name("order ", "o_orderkey"), _name("c/", "o_custkey"), F.col("n_name"), F.col("c_mktsegment")))
        .union(_node(t("part"), F.lit("function"), _name("part:", "p_partkey"), F.col("p_name"), None, F.col("p_brand"), None))
    )


def keyed_claims(spark: SparkSession, sf_dir: str, snapshot: str = HEAD) -> DataFrame:
    """One row per line item and relation, before the strongest claim wins, by the tables' own keys: o_orderkey and test are the source, relation and target the destination.

    A line takes its score (model.claim_score) along, not what that follows from. Lines meet their orders by a shuffle whatever the sizes: after it claims of an order lie together, and a broadcast would have each relation's claim shuffled instead.
    """
    orders = table(spark, sf_dir, "orders").where(WINDOW[snapshot]).select("o_orderkey", F.coalesce(F.col("o_orderstatus") == "F", F.lit(False)).alias("test"))
    score = model.claim_score(
        F.expr("CASE l_linestatus WHEN 'F' THEN 'compiler' ELSE 'heuristic' END"),
        F.expr(f"CASE WHEN {CERTAIN[snapshot]} THEN 'certain' WHEN l_returnflag = 'A' THEN 'likely' ELSE 'inferred' END"),
        F.expr("CASE WHEN l_quantity > 25 THEN 'resolved' WHEN l_quantity > 5 THEN 'partial' ELSE 'unresolved' END"),
    )
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", score.alias("score"))
    line = line.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    end = lambda relation, target: F.struct(F.lit(relation).alias("relation"), F.col(target).alias("target"))
    targets = F.array(end("calls", "l_partkey"), end("imports", "l_suppkey"), F.when(F.col("test"), end("tests", "l_partkey")))
    return line.select("o_orderkey", "test", F.inline(F.filter(targets, lambda x: x.isNotNull())), "score")


def named_claims(spark: SparkSession, sf_dir: str, snapshot: str = HEAD) -> DataFrame:
    """The strongest claim of each pair of ends and relation. Claims meet by the tables' keys, which a join by order has dealt out already; names and digests are made of what is left."""
    best = model.strongest_scores(keyed_claims(spark, sf_dir, snapshot), ["o_orderkey", "test", "relation", "target"])
    to_file = F.col("relation") == "imports"
    return best.select(
        F.when(F.col("test"), "test").otherwise("method").alias("src_kind"), _name("order:", "o_orderkey").alias("src_name"), "relation",
        F.when(to_file, "file").otherwise("function").alias("dst_kind"), F.when(to_file, _name("s/", "target")).otherwise(_name("part:", "target")).alias("dst_name"),
        "origin", "confidence", "resolution", "n_claims",
    )


def named_edges(spark: SparkSession, sf_dir: str, snapshot: str = HEAD) -> DataFrame:
    """Edges by the kinds and qualified names of their ends."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation")
    named = lambda df, kind, name, to_kind, to_name: df.select(F.lit(kind).alias("src_kind"), name.alias("src_name"), F.lit("contains").alias("relation"), to_kind.alias("dst_kind"), to_name.alias("dst_name"))
    region = named(t("region").join(nation, F.col("r_regionkey") == F.col("n_regionkey")), "package", _name("region:", "r_name"), F.lit("package"), _name("nation:", "n_name"))
    customer = named(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "package", _name("nation:", "n_name"), F.lit("file"), _name("c/", "c_custkey"))
    supplier = named(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "package", _name("nation:", "n_name"), F.lit("file"), _name("s/", "s_suppkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "test").otherwise("method")
    method = named(t("orders").where(WINDOW[snapshot]), "file", _name("c/", "o_custkey"), kind, _name("order:", "o_orderkey"))
    contains = region.union(customer).union(supplier).union(method).select("*", F.lit("compiler").alias("origin"), F.lit("certain").alias("confidence"), F.lit("resolved").alias("resolution"))
    return contains.unionByName(named_claims(spark, sf_dir, snapshot).drop("n_claims"))


def edges(spark: SparkSession, sf_dir: str, snapshot: str = HEAD) -> DataFrame:
    return model.with_edge_keys(named_edges(spark, sf_dir, snapshot))


_STORES: dict[tuple[str, str, str], NamedStore] = {}
_READ = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _state(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the input files' names, lengths and times; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{sf_dir}/{t}.parquet" for t in _READ])
    mark = F.xxhash64("path", "length", "modificationTime")
    n, total = files.agg(F.count("*"), F.sum(mark.cast("decimal(20,0)"))).first()
    return f"{n}:{total}"


def published(spark: SparkSession, sf_dir: str, snapshot: str = HEAD, form: str = "keyed") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a snapshot as a session's store has them; the first to ask publishes it, with its files. Changed input files have a store of their own. form: keyed; plain, by plain keys, for results without keys; named, edges as they are stored."""
    name = spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir)
    store = _STORES.setdefault(name, NamedStore(spark, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"))
    while True:
        log = {r["workspace_hash"]: r for r in store.activations().collect()}  # a row a snapshot
        if snapshot in log:
            found = log[snapshot]["snapshot_id"]
            break
        n, e = nodes(spark, sf_dir, snapshot), named_edges(spark, sf_dir, snapshot)
        files = n.where("kind = 'file'").select(F.col("file").alias("path"), "package", "language")
        head = store.head()
        try:
            found = store.publish(n, e, snapshot, head[0] if head else None, files=files)
            break
        except Conflict:
            if store.activations().count() == len(log):
                raise  # no other has published meanwhile
    if form == "plain":
        return store.read_plain(found)
    return store.read("nodes", found), store.read_named(found) if form == "named" else store.read("edges", found)


def nodes_sql(snapshot: str = HEAD) -> str:
    """The same nodes in SQL, for oracles."""
    return f"""
SELECT sha256('node|package|region:' || r_name) AS node_key, 'package' AS kind, 'region:' || r_name AS qualified_name, r_name AS display_name, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS package, CAST(NULL AS VARCHAR) AS language FROM region
UNION ALL SELECT sha256('node|package|nation:' || n_name), 'package', 'nation:' || n_name, n_name, NULL, NULL, NULL FROM nation
UNION ALL SELECT sha256('node|file|c/' || c_custkey), 'file', 'c/' || c_custkey, c_name, 'c/' || c_custkey, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT sha256('node|file|s/' || s_suppkey), 'file', 's/' || s_suppkey, s_name, 's/' || s_suppkey, n_name, 'SUPPLY' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT sha256('node|' || CASE o_orderstatus WHEN 'F' THEN 'test' ELSE 'method' END || '|order:' || o_orderkey), CASE o_orderstatus WHEN 'F' THEN 'test' ELSE 'method' END, 'order:' || o_orderkey, 'order ' || o_orderkey, 'c/' || o_custkey, n_name, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE {WINDOW[snapshot]}
UNION ALL SELECT sha256('node|function|part:' || p_partkey), 'function', 'part:' || p_partkey, p_name, NULL, p_brand, NULL FROM part"""


def claims_sql(snapshot: str = HEAD) -> str:
    line = f"(SELECT l.*, o_orderstatus, sha256('node|' || CASE o_orderstatus WHEN 'F' THEN 'test' ELSE 'method' END || '|order:' || o_orderkey) AS src FROM lineitem AS l JOIN orders ON l_orderkey = o_orderkey WHERE {WINDOW[snapshot]})"
    claim = f"CASE l_linestatus WHEN 'F' THEN 'compiler' ELSE 'heuristic' END AS origin, CASE WHEN {CERTAIN[snapshot]} THEN 'certain' WHEN l_returnflag = 'A' THEN 'likely' ELSE 'inferred' END AS confidence, CASE WHEN l_quantity > 25 THEN 'resolved' WHEN l_quantity > 5 THEN 'partial' ELSE 'unresolved' END AS resolution"
    return f"""
SELECT src, 'calls' AS relation, sha256('node|function|part:' || l_partkey) AS dst, {claim} FROM {line}
UNION ALL SELECT src, 'imports', sha256('node|file|s/' || l_suppkey), {claim} FROM {line}
UNION ALL SELECT src, 'tests', sha256('node|function|part:' || l_partkey), {claim} FROM {line} WHERE o_orderstatus = 'F'"""


def edges_sql(snapshot: str = HEAD) -> str:
    return f"""
SELECT sha256('edge|' || src || '|' || relation || '|' || dst) AS edge_key, * FROM (
SELECT sha256('node|package|region:' || r_name) AS src, 'contains' AS relation, sha256('node|package|nation:' || n_name) AS dst, 'compiler' AS origin, 'certain' AS confidence, 'resolved' AS resolution FROM region JOIN nation ON r_regionkey = n_regionkey
UNION ALL SELECT sha256('node|package|nation:' || n_name), 'contains', sha256('node|file|c/' || c_custkey), 'compiler', 'certain', 'resolved' FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT sha256('node|package|nation:' || n_name), 'contains', sha256('node|file|s/' || s_suppkey), 'compiler', 'certain', 'resolved' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT sha256('node|file|c/' || o_custkey), 'contains', sha256('node|' || CASE o_orderstatus WHEN 'F' THEN 'test' ELSE 'method' END || '|order:' || o_orderkey), 'compiler', 'certain', 'resolved' FROM orders WHERE {WINDOW[snapshot]}
UNION ALL SELECT src, relation, dst, c.origin, c.confidence, c.resolution FROM (SELECT src, relation, dst, arg_max(struct_pack(origin, confidence, resolution),
  100 * (list_position(['inferred', 'likely', 'certain'], confidence) - 1) + 10 * (list_position(['unresolved', 'partial', 'resolved'], resolution) - 1) + CASE origin WHEN 'compiler' THEN 5 ELSE 1 END) AS c FROM ({claims_sql(snapshot)}) GROUP BY src, relation, dst))"""


def with_graph(body: str, snapshot: str = HEAD, recursive: bool = False) -> str:
    """A query over the CTEs nodes and edges."""
    return f"WITH {'RECURSIVE ' if recursive else ''}nodes AS MATERIALIZED ({nodes_sql(snapshot)}), edges AS MATERIALIZED ({edges_sql(snapshot)}){body}"
