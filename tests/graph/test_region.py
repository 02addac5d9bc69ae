import pytest

from tessera.operators import store

NODES = "node_key string, kind string, qualified_name string, display_name string, file string, language string"
EDGES = "edge_key string, src string, relation string, dst string, origin string, confidence string, resolution string"


def graph(spark, nodes, edges, evidence):
    n = spark.createDataFrame([(k, kind, k, k, file, "go" if kind == "file" else None) for k, kind, file in nodes], NODES)
    e = spark.createDataFrame([(k, a, "calls", b, "compiler", "certain", "resolved") for k, a, b in edges], EDGES)
    return n, e, spark.createDataFrame(evidence, "edge_key string, file string, line int")


OLD = [("fa", "file", "a"), ("fb", "file", "b"), ("x", "function", "a"), ("y", "function", "b"), ("z", "function", "b"), ("ext", "external_dep", None), ("ext2", "external_dep", None)]


def test_edges_go_by_their_evidence_and_ends_are_checked(spark):
    edges = [("e1", "x", "y"), ("e2", "y", "z"), ("e3", "z", "y"), ("e4", "z", "ext"), ("e5", "x", "ext2")]
    n, e, proof = graph(spark, OLD, edges, [("e1", "a", 1), ("e2", "b", 2), ("e2", "a", 9), ("e3", "b", 3), ("e4", "b", 4), ("e5", "a", 5)])
    region = spark.createDataFrame([("a",)], "path string")
    new = graph(spark, [("fa", "file", "a"), ("x", "function", "a"), ("ext", "external_dep", None)], [("n1", "x", "z")], [("n1", "a", 7)])
    nodes, merged, _ = store.replace_region(n, e, proof, *new, region)
    assert sorted((r.src, r.dst) for r in merged.collect()) == [("x", "z"), ("z", "ext"), ("z", "y")]  # e2 went by its second evidence
    assert sorted(r.node_key for r in nodes.collect()) == ["ext", "fa", "fb", "x", "y", "z"]  # ext once, ext2 not at all
    outside = graph(spark, [("fa", "file", "a"), ("x", "function", "a")], [("n1", "x", "nowhere")], [])
    for replacement, files, words in ((outside, region, "ends outside"), (new, region.limit(0), "no file"), (new, region.union(region), "twice"),
                                      (graph(spark, [("fa", "file", "a"), ("w", "function", "a")], [], []), region, "declaration"), (graph(spark, [], [], []), region, "missing replacement")):
        with pytest.raises(store.UnsafeMerge, match=words):
            store.replace_region(n, e, proof, *replacement, files)
