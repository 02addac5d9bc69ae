import re

import pytest

from tessera import model
from tessera.operators import aggregate, reports
from tessera.plans import catalog
from tessera.sources import testdata

SF = "/root/testdata/sf0.001"


def test_claims_of_an_order_meet_once(spark):
    plan = testdata.named_claims(spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert dealt and all(re.fullmatch(r"[lo]_orderkey#\w+, \d+", x) for x in dealt)
    assert "l_quantity" not in plan.split("hashpartitioning(l_orderkey")[0]


def test_scores_give_the_strongest_claim(spark):
    rows = [("a", "compiler", "likely", "resolved"), ("a", "heuristic", "certain", "partial"), ("b", "git", "inferred", "unresolved")]
    df = spark.createDataFrame(rows, "k string, origin string, confidence string, resolution string")
    scored = df.withColumn("score", model.claim_score(df["origin"], df["confidence"], df["resolution"])).select("k", "score")
    assert sorted(model.strongest_scores(scored, ["k"]).collect()) == sorted(model.strongest_claims(df, ["k"]).collect()) == [("a", "heuristic", "certain", "partial", 2), ("b", "git", "inferred", "unresolved", 1)]


def test_first_target_by_names(spark):
    rows = [("method", f"m|{i % 7}", "imports" if i % 3 else "calls", "file", f"s\\{i % 5}", f"o{i}") for i in range(40)]
    named = spark.createDataFrame(rows, "src_kind string, src_name string, relation string, dst_kind string, dst_name string, origin string").dropDuplicates(["src_name", "relation", "dst_name"])
    want = reports.first_target(model.with_edge_keys(named), "imports")
    assert sorted(reports.first_named_target(named, "imports").select("src", "dst").collect()) == sorted(want.select("src", "dst").collect())


def test_digests_travel_as_bytes(spark):
    import hashlib

    rows = spark.createDataFrame([(str(i), None if i % 4 == 0 else "v") for i in range(300)], "a string, b string")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    hashes = sorted(digest(f"{i}\u0001" + ("\u0002" if i % 4 == 0 else "v")) for i in range(300))
    buckets = sorted({h[:2] for h in hashes})
    want = digest("\n".join(digest("\n".join(h for h in hashes if h[:2] == b)) for b in buckets))
    out = aggregate.set_digest(rows, ["a", "b"])
    assert out.first() == (want, 300)
    assert "collect_list(unhex(" in out._jdf.queryExecution().executedPlan().toString() or "unhex(" in out._jdf.queryExecution().optimizedPlan().toString()


def test_hotspots_by_another_key(spark):
    nodes = spark.createDataFrame([(f"function|p{i}", f"n{i % 2}") for i in range(5)], "node_key string, display_name string")
    edges = spark.createDataFrame([("calls", f"function|p{i % 5}") for i in range(10)], "relation string, dst string")
    keyed = nodes.withColumn("node_key", model.key_of_plain(nodes["node_key"]))
    want = aggregate.hotspots(keyed, edges.withColumn("dst", model.key_of_plain(edges["dst"])), 3).collect()
    assert aggregate.hotspots(nodes, edges, 3, model.key_of_plain).collect() == want


@pytest.mark.parametrize("name", ["dangling_endpoints", "fan_in_topk", "first_import", "node_diff", "structural_remarks", "weakest_confidence"])
def test_no_digest_is_shuffled(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth, below, dealt = lambda x: re.search(r"[A-Za-z*(]", x).start(), None, 0
    for line in filter(str.strip, lines):
        if below is not None and depth(line) <= below:
            below = None
        if below is not None:
            assert "sha2(" not in line
        elif "- Exchange" in line:
            below, dealt = depth(line), dealt + 1
    assert dealt
