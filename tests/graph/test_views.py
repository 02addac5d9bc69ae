import random

from pyspark.sql import functions as F

from tessera.operators import extract, refresh, views
from tests.graph.test_operators import edges, node_frame, nodes, rows


def test_visibility_and_representation(spark):
    df = spark.createDataFrame([("a", "file", None), ("b", "test", "x"), ("c", "type", "x")], "k string, kind string, lang string")
    assert [tuple(x) for x in views.with_visibility(df, {"kind": ["file", "test"], "lang": ["x"]}).select("k", "visible").orderBy("k").collect()] == [("a", False), ("b", True), ("c", False)]
    r = spark.createDataFrame([("long body", "sig", "n"), (None, "sig", "n"), (None, "long signature", "n")], "b string, s string, n string")
    assert [x[0].kind for x in r.select(views.representation(F.col("b"), F.col("s"), F.col("n"), 9)).collect()] == ["body", "signature", "name"]
    e = spark.range(1).select(F.array(*[F.lit(i) for i in range(25)]).alias("e"))
    head, omitted = views.first_evidence(F.col("e"))
    assert e.select(F.size(head), omitted).first() == (20, 5)


def test_parents_follow_the_queue(spark):
    e = edges(spark, ("r", "calls", "b", "e2"), ("r", "calls", "a", "e9"), ("a", "calls", "x", "e1"), ("b", "calls", "x", "e7"), ("b", "calls", "y", "e3"))
    walk = views.walk_with_parents(e, node_frame(spark, "r"), 2)
    assert rows(walk.select("node", "hop", "parent")) == [("a", 1, "r"), ("b", 1, "r"), ("r", 0, None), ("x", 2, "b"), ("y", 2, "b")]  # b is queued before a
    assert rows(views.connectors(walk, node_frame(spark, "x", "a"), 2)) == [("b",)]


def test_collapsed(spark):
    own = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("p", "p"), ("d", None)], "node_key string, owner string")
    e = edges(spark, ("a", "calls", "b"), ("a", "calls", "c"), ("b", "calls", "c"), ("d", "calls", "a"))
    assert rows(views.collapsed_edges(e, own, [])) == [("d", "p", "calls", 1), ("p", "q", "calls", 2)]
    assert rows(views.collapsed_edges(e, own, ["p"])) == [("a", "b", "calls", 1), ("a", "q", "calls", 1), ("b", "q", "calls", 1), ("d", "a", "calls", 1)]


def test_hulls(spark):
    r = random.Random(1)
    points = [("g", r.random(), r.random()) for _ in range(300)] + [("g", 0.0, 0.0), ("g", 2.0, 0.0), ("g", 2.0, 2.0), ("g", 0.0, 2.0), ("one", 1.0, 1.0), ("two", 0.0, 0.0), ("two", 1.0, 1.0)]
    got = views.hulls(spark.createDataFrame(points, "g string, x double, y double"), "g").orderBy("g", "corner").collect()
    assert [(x.x, x.y) for x in got if x.g == "g"] == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert len([x for x in got if x.g == "one"]) == 1 and len([x for x in got if x.g == "two"]) == 2


def test_declarations_and_plug_in(spark):
    f = spark.createDataFrame([("a.proto", "protobuf", "message M {\n}\nservice S {\n rpc Call (M) returns (M);\n}"), ("Makefile", "make", "all: x\nV := 1"), ("x.sh", "shell", "go() {\n")], "path string, language string, text string")
    assert rows(extract.declarations(f)) == [("Makefile", 1, "function", "all"), ("a.proto", 1, "type", "M"), ("a.proto", 3, "interface", "S"), ("a.proto", 4, "method", "Call"), ("x.sh", 1, "function", "go")]
    got = extract.extracted(f, lambda p, t: ({"path": p, "n": len(w)} for w in t.split()[:1]), "path string, n int")
    assert rows(got) == [("Makefile", 4), ("a.proto", 7), ("x.sh", 4)]


def test_http_links(spark):
    calls = spark.createDataFrame([(1, "get", "https://h/users/12?x=1"), (2, "POST", "/users"), (3, "GET", "/none")], "id int, method string, url string")
    servers = spark.createDataFrame([("s1", "GET", "/users/:id"), ("s2", "post", "/users"), ("s3", "POST", "/users/")], "candidate string, method string, route string")
    assert [(x.id, x.candidate, x.status) for x in extract.http_links(calls, servers).orderBy("id").collect()] == [(1, "s1", "matched"), (2, None, "ambiguous"), (3, None, "none")]


def test_projects_diagnostics_contract(spark):
    f = spark.createDataFrame([("a/package.json",), ("go.mod",), ("x.ts",)], "path string")
    got = extract.projects(f, {"package.json": ("typescript", "javascript"), "go.mod": ("go",)})
    assert rows(got.select("root", "languages")) == [(".", ["go"]), ("a", ["javascript", "typescript"])]
    d = spark.createDataFrame([("c", None, " ", "f", 3, None), ("c", None, " ", "f", 3, None), ("e", "error", "m", None, None, None)], "code string, severity string, message string, file string, line int, end_line int")
    assert rows(extract.diagnostics(d)) == [("c", "warning", "c", "f", 3, 3), ("e", "error", "m", None, None, None)]
    n = nodes(spark, ("a", "file", "a", None), ("a", "odd", "a", None))
    e = extract.with_provenance(edges(spark, ("a", "calls", "z"), ("a", "bad", "a", "k", "git", "likely", "unresolved")), "x", "1")
    assert {x.derivation for x in e.collect()} == {"type_checked", "mined"}
    assert {tuple(x) for x in extract.contract_faults(n, e).collect()} == {("a", "repeated node_key"), ("a", "unknown kind"), ("k", "unknown relation"), ("a>calls>z", "dangling")}
    assert ("k", "no reason") in rows(extract.contract_faults(n, e.withColumn("reason", F.lit(None).cast("string"))))


def test_refresh_decisions(spark):
    kind = "path string, hash string, language string"
    before = spark.createDataFrame([("a.ts", "1", "typescript"), ("b.ts", "1", "typescript"), ("c.py", "1", "python"), ("package.json", "1", "json")], kind)
    imports = spark.createDataFrame([("b.ts", "a.ts"), ("z.ts", "b.ts")], "src string, dst string")
    change = lambda p: before.withColumn("hash", F.when(F.col("path") == p, "2").otherwise(F.col("hash")))
    assert refresh.decide(before, before, imports).mode == "noop"
    got = refresh.decide(before, change("a.ts"), imports)
    assert got.mode == "regional" and rows(got.region) == [("a.ts",), ("b.ts",), ("z.ts",)]
    for now, word in ((change("c.py"), "language"), (change("package.json"), "configuration"), (before.where("path <> 'a.ts'"), "added or removed")):
        d = refresh.decide(before, now, imports)
        assert d.mode == "full" and word in d.reason
    assert refresh.decide(before, before, imports, hints=("rescan",)).mode == "full" and refresh.decide(before, before, imports, same_head=False).mode == "full"
