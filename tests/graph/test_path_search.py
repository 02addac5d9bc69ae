from pyspark.sql import functions as F

from tessera.operators import traverse
from tessera.plans import catalog, catalog_sources

SF = "/root/testdata/sf0.001"


def test_ways_that_miss_the_target_do_not_limit(spark):
    rows = [("s", f"d{i}", f"e{i}") for i in range(40)] + [(f"d{i}", f"f{i}", f"g{i}") for i in range(40)] + [("d7", "t", "h1"), ("d3", "t", "h2")]
    e = spark.createDataFrame(rows, "src string, dst string, edge_key string").withColumn("relation", F.lit("calls"))
    s, t = (spark.createDataFrame([(x,)], "node string") for x in "st")
    got = traverse.k_paths(e, s, t, 3, most_rows=10).orderBy("rank").collect()
    assert [(x["status"], x["edge_keys"]) for x in got] == [("ok", ["e3", "h2"]), ("ok", ["e7", "h1"])]
    assert traverse.path_search(e, t, s, 1).status == "no_path"
    assert traverse.path_search(e, s, spark.createDataFrame([("z",)], "node string"), 1, most_rows=10).status == "search_limit"


def test_no_number_limits_k_paths(spark, monkeypatch):
    seen = []
    real = traverse.path_search
    monkeypatch.setattr(traverse, "path_search", lambda *a: seen.append(a[5]) or real(*a))
    catalog.QUERIES["k_paths"](spark, SF)
    assert seen == [None]


def test_each_search_is_asked_for_the_same_call(spark, monkeypatch):
    asked = []
    real = traverse.path_search
    monkeypatch.setattr(traverse, "path_search", lambda e, s, t, *a, **k: asked.append((s, t)) or real(e, s, t, *a, **k))
    assert [x["status"] for x in catalog.QUERIES["path_status"](spark, SF).orderBy("case_").collect()] == ["ok", "no_path", "search_limit"]
    assert not any("Limit" in df._jdf.queryExecution().optimizedPlan().toString() for pair in asked for df in pair)
    assert catalog_sources.path_status
