import pytest
from pyspark.sql import functions as F

from tessera.operators import reports
from tessera.sources import captures
from tests.graph.test_operators import edges, node_frame, nodes, rows


def test_append_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    kind = "retrieval string, rank int, target string"
    reports.append_checked(spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], kind), path, ["retrieval", "target"], ["target"])
    for bad, word in (([("s", 1, "a"), ("s", 2, "a")], "repeated"), ([("s", 1, None)], "missing"), ([("s", 1, "a"), ("s", 3, "b")], "gaps")):
        with pytest.raises(ValueError, match=word):
            reports.append_checked(spark.createDataFrame(bad, kind), path, ["retrieval", "target"], ["target"])
    assert spark.read.parquet(path).count() == 2


def test_mentions(spark):
    s = spark.createDataFrame([(1, "f(a: Foo): ns.Bar"), (2, "g(x: Food)")], "id int, signature string")
    t = spark.createDataFrame([("k1", "Foo", "ns.Foo"), ("k2", "Bar", "ns.Bar")], "node_key string, display_name string, qualified_name string")
    assert rows(reports.mentions(s, t)) == [(1, "k1"), (1, "k2")]


def test_layout_and_directions(spark):
    seeds = spark.createDataFrame([("g", "a", 0.0, 0.0), ("g", "b", 1.0, 0.1), ("g", "c", 0.2, 9.0), ("big", "x", 3.0, 4.0), ("big", "y", 3.0, 4.5), ("big", "z", 1.0, 1.0), ("big", "w", 2.0, 1.0)], "g string, node string, x double, y double")
    links = spark.createDataFrame([("g", "a", "c")], "g string, a string, b string")
    got = {x.node: (x.x, x.y) for x in reports.relax(seeds, links, "g", rounds=80, most=3).collect()}
    assert set(got) == {"a", "b", "c", "x", "y", "z", "w"} and got["x"] == (3.0, 4.0)
    far = lambda p, q: ((got[p][0] - got[q][0]) ** 2 + (got[p][1] - got[q][1]) ** 2) ** 0.5
    assert far("a", "c") < 9 and far("a", "c") < far("b", "c")
    pts = seeds.where("g = 'g'").select("node", "x", "y")
    assert rows(reports.nearest_in_direction(pts, "a", 1, 0)) == [("b",)] and rows(reports.nearest_in_direction(pts, "a", 0, 1)) == [("c",)] and rows(reports.nearest_in_direction(pts, "a", -1, 0)) == []
    marks = spark.createDataFrame([("a", "violation"), ("q", "change")], "node_key string, badge string")
    assert [x.placed for x in reports.badges(marks, pts.withColumnRenamed("node", "node_key")).orderBy("node_key").collect()] == [True, False]


def test_append_layout_keeps_placed_nodes_and_radius(spark):
    placed = spark.createDataFrame([("g", f"p{i}", float(i), 0.0) for i in range(4)] + [("h", "q", 100.0, 0.0)], "g string, node string, x double, y double")
    added = spark.createDataFrame([("g", "a"), ("g", "b"), ("none", "c")], "g string, node string")
    links = spark.createDataFrame([("g", "a", "p0")], "g string, a string, b string")
    seeds = {r.node: r for r in reports.append_seeds(placed, added, "g").collect()}
    assert (seeds["a"].cx, seeds["a"].cy) == (1.5, 0.0) and seeds["c"].cx == 21.2
    assert all(abs(r.x - r.cx) <= 0.5 and abs(r.y - r.cy) <= 0.5 for r in seeds.values())
    for radius in (25.0, 0.01):
        got = {r.node: r for r in reports.append_layout(placed, added, links, "g", radius).collect()}
        assert set(got) == {"a", "b", "c"}
        assert all(((r.x - seeds[n].cx) ** 2 + (r.y - seeds[n].cy) ** 2) ** 0.5 <= radius + 1e-9 for n, r in got.items())
    pins = placed.selectExpr("*", "true AS pinned")
    assert {r.node: (r.x, r.y) for r in reports.relax(pins, links, "g").collect()} == {r.node: (r.x, r.y) for r in placed.collect()}
    assert reports.append_layout(placed, added.limit(0), links, "g").collect() == []
    assert {r.cx for r in reports.append_seeds(placed.limit(0), added, "g").collect()} == {0.0}


def test_pages_and_documents(spark):
    df = spark.range(5).toDF("k")
    got, more = reports.first_rows(df, [F.asc("k")], 3)
    assert [x.k for x in got] == [0, 1, 2] and more and not reports.first_rows(df, [F.asc("k")], 5)[1]
    e = edges(spark, ("d", "documents", "a"), ("d", "documents", "b"), ("r", "routes_to", "h2", "k2"), ("r", "routes_to", "h1", "k1"))
    assert rows(reports.documents_of(e, node_frame(spark, "a"))) == [("d", "a", "certain")] and reports.documents_of(e).count() == 2
    assert rows(reports.first_target(e, "routes_to")) == [("r", "h1", "compiler")]


def test_generated(spark):
    df = spark.createDataFrame([("a.d.ts", "typescript"), ("a/site-packages/x.py", "python"), ("x.py", "python"), ("a.d.ts", None)], "p string, l string")
    assert [x[0] for x in df.select(captures.is_generated(F.col("p"), F.col("l"))).collect()] == [True, True, False, False]


def test_questions_leave_empty_ones_out(spark):
    n = nodes(spark, ("a", "file", "a", None), ("b", "file", "b", None))
    e = edges(spark, ("a", "imports", "b"))
    own = spark.createDataFrame([("a", "owned")], "node_key string, status string")
    assert [x.position for x in reports.questions(n, e, own).orderBy("position").collect()] == [3, 4]
