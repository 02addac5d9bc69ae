"""Long tables meet in passes by plain keys."""

import pytest

from tessera import model
from tessera.functions import shared
from tessera.operators import diff
from tessera.plans import catalog, catalog_code, catalog_sources  # noqa: F401

SF = "/root/testdata/sf0.001"
NAMED = "src_kind string, src_name string, relation string, dst_kind string, dst_name string, origin string, confidence string, resolution string"


def named(spark, *rows):
    """(src, relation, dst, origin): methods by name."""
    return spark.createDataFrame([("method", a, r, "method", b, o, "certain", "resolved") for a, r, b, o in rows], NAMED)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_named_edge_diff(spark):
    base = named(spark, *[(f"a|{i}", "calls", f"b\\{i % 3}", "git") for i in range(40)], ("x", "calls", "y", "git"), ("x", "calls", "y", "git"))
    head = named(spark, *[(f"a|{i}", "calls", f"b\\{i % 3}", "doc" if i % 2 else "git") for i in range(20, 60)])
    got, want = diff.named_edge_diff(base, head), diff.edge_diff(model.with_edge_keys(base), model.with_edge_keys(head))
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_passes_free_their_shuffles(spark):
    files = lambda: sum(1 for _ in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").splitlines() if "shuffle" in _)
    before = files()
    rows = spark.range(1000).selectExpr("id % 50 AS k")
    out = shared.in_passes(lambda i: rows.where(f"k % {shared.PASSES} = {i}").groupBy("k").count(), "counts")
    assert out.count() == 50 and sorted(x["count"] for x in out.collect()) == [20] * 50
    assert files() <= before + 8  # those of the count itself


@pytest.mark.parametrize("name", ["edge_diff", "live_graph_diff"])
def test_results_of_passes_have_no_shuffle(spark, name):
    assert "Exchange" not in plan(catalog.QUERIES[name](spark, SF))


def test_node_detail_by_plain_keys(spark):
    from tessera.operators import detail

    e = named(spark, ("a", "calls", "b|", "git"), ("b|", "calls", "c", "git"), ("x", "calls", "c", "git"))
    n = spark.createDataFrame([("method", q, q) for q in ("a", "b|", "c", "x", "lone")], "kind string, qualified_name string, display_name string")
    n = n.withColumn("node_key", model.node_key(n["kind"], n["qualified_name"]))
    wanted = spark.createDataFrame([("b|",), ("lone",), ("nobody",)], "query string")
    got, want = detail.node_detail(n, model.plain_ends(e), wanted), detail.node_detail(n, model.with_edge_keys(e), wanted)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 4


def test_node_detail_deals_out_no_edges(spark):
    assert "Exchange hashpartitioning(src" not in plan(catalog.QUERIES["node_detail"](spark, SF))


def test_contract_faults_by_plain_keys(spark):
    from tessera.operators import extract

    e = named(spark, ("a", "calls", "b", "git"), ("a", "calls", "b", "git"), ("b", "odd", "z", "git"), ("y", "calls", "a", "git"))
    n = spark.createDataFrame([("method", "a"), ("method", "b"), ("method", "b"), ("thing", "c")], "kind string, qualified_name string")
    keyed, plain_nodes = n.withColumn("node_key", model.node_key(n["kind"], n["qualified_name"])), n.withColumn("node_key", model.plain_key(n["kind"], n["qualified_name"]))
    want = extract.contract_faults(keyed, model.with_edge_keys(e))
    got = extract.contract_faults(plain_nodes, model.passing(e).selectExpr("*", "struct(src, relation, dst) AS edge_key"), model.key_of_plain, lambda k: model.edge_key_of_plain("key.src", "key.relation", "key.dst"))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 6
    assert "Exchange" not in plan(got)


def test_orphan_chain_by_ends(spark):
    from tessera.operators import store

    e = named(spark, *[(f"m{i}", "calls", f"m{i + 1}", "git" if i % 3 else "doc") for i in range(12)])
    n = spark.createDataFrame([(f"m{i}", f"f{i // 4}") for i in range(16)], "q string, file string")
    by = lambda edges, key, col: store.orphan_chain(edges, n.select(col.alias("node_key"), "file"), n.select("file").distinct(), edges.where("origin = 'git'"), n.limit(0).select(n["q"].alias("node_key")), n.limit(0).select("file"), key)
    from pyspark.sql import functions as F

    plain_, keyed = by(model.passing(e), ["src", "relation", "dst"], model.plain_key(F.lit("method"), F.col("q"))), by(model.with_edge_keys(e), ["edge_key"], model.node_key(F.lit("method"), F.col("q")))
    assert [df.count() for df in plain_] == [df.count() for df in keyed] == [4, 4, 0]
    assert "Exchange" not in plan(plain_[0])


def test_merge_region_by_plain_keys(spark):
    from tessera.operators import store

    e = named(spark, *[(f"m{i}", "calls", f"m{i + 1}", "git") for i in range(8)], ("m1", "calls", "m2", "doc"))
    n = spark.createDataFrame([("method", f"m{i}", f"f{i // 4}") for i in range(9)], "kind string, qualified_name string, file string")
    files = spark.createDataFrame([("f1",)], "file string")
    with_key = lambda key: n.withColumn("node_key", key(n["kind"], n["qualified_name"]))
    merged = lambda nodes, edges: store.merge_region(nodes, edges, nodes.where("file = 'f1'"), edges.limit(0), files)[1]
    got, want = merged(with_key(model.plain_key), model.passing(e)), merged(with_key(model.node_key), model.with_edge_keys(e))
    keys = lambda df: sorted(x["edge_key"] for x in df.collect())
    assert keys(got) == keys(want) and len(keys(got)) == 4  # those of m0 to m3; m8 has none
    assert "Exchange" not in plan(got)
