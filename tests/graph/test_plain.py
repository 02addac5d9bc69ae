import re

from pyspark.sql import functions as F

from tessera import model
from tessera.operators import traverse
from tessera.operators import project as P
from tessera.operators.store import NamedStore

NODES = "kind string, qualified_name string, file string, package string"
NAMED = "src_kind string, src_name string, relation string, dst_kind string, dst_name string, origin string, confidence string, resolution string"


def small(spark):
    nodes = spark.createDataFrame([("file", "a", "a", "p"), ("file", "b|\\", "b", "q"), ("test", "a", "a", "q"), ("method", "file|a", "a", None)], NODES)
    nodes = nodes.select(model.node_key(F.col("kind"), F.col("qualified_name")).alias("node_key"), "*")
    claim = ("compiler", "certain", "resolved")
    edges = spark.createDataFrame([("file", "a", "calls", "file", "b|\\", *claim), ("test", "a", "tests", "file", "a", *claim), ("method", "file|a", "calls", "file", "b|\\", *claim)], NAMED)
    return nodes, edges


def test_regions_by_plain_keys(spark, tmp_path):
    nodes, edges = small(spark)
    store = NamedStore(spark, f"file://{tmp_path}/graph")
    found = store.publish(nodes, edges, "w", None)
    count = lambda n, e: sorted(map(str, P.region_counts(n, e, n.select("node_key", F.coalesce("package", F.lit("-")).alias("region")), ["file"]).collect()))
    n, e = store.read_plain(found)
    assert count(n, e) == count(store.read("nodes", found), store.read("edges", found))
    keys = [r["node_key"] for r in n.collect()]
    assert len(set(keys)) == 4 and not any(re.fullmatch("[0-9a-f]{64}", k) for k in keys)  # digests take 64 bytes an end in every shuffle
    assert {model_key for (model_key,) in n.select(model.key_of_plain(F.col("node_key"))).collect()} == {r["node_key"] for r in nodes.collect()}


def test_context_keeps_no_edge_keys(spark, monkeypatch):
    kept = {}
    write = traverse.materialize
    monkeypatch.setattr(traverse, "materialize", lambda df, name, **o: kept.setdefault(name, (df.columns, o)) and write(df, name, **o))
    nodes, edges = small(spark)
    plain_nodes = nodes.withColumn("node_key", model.plain_key(F.col("kind"), F.col("qualified_name")))
    anchor = spark.createDataFrame([("file", "b|\\")], "kind string, q string")
    rows = lambda e, n, key: sorted(map(tuple, traverse.context(e, n, anchor.select(key(F.col("kind"), F.col("q")).alias("node"))).collect()))
    keyed = rows(model.with_edge_keys(edges), nodes, model.node_key)
    assert kept["use"] == (["src", "dst", "relation", "origin", "confidence", "resolution"], {"compression": "zstd"})
    byplain = traverse.context(model.plain_ends(edges), plain_nodes, anchor.select(model.plain_key(F.col("kind"), F.col("q")).alias("node")))
    assert len(keyed) == 3 and sorted(map(tuple, byplain.withColumn("node", model.key_of_plain(F.col("node"))).collect())) == keyed
