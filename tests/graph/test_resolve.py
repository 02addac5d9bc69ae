import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregate, detail, resolve, search, store, traverse
from tessera.sources import captures
from tests.graph.test_operators import edges, node_frame, nodes, rows


def test_exports_through_cycles_and_renames(spark):
    own = spark.createDataFrame([("a", "f", "s1"), ("b", "f", "s2"), ("c", "g", "s3")], "module string, name string, symbol string")
    again = spark.createDataFrame([("x", "*", "a", "*"), ("a", "*", "x", "*"), ("x", "h", "c", "g"), ("y", "*", "x", "*"), ("b", "*", "a", "*")], "module string, name string, source string, source_name string")
    got = {(r.module, r.name): (r.symbol, r.n_hops) for r in resolve.resolve_exports(own, again).collect()}
    assert got == {("a", "f"): ("s1", 0), ("b", "f"): ("s2", 0), ("c", "g"): ("s3", 0), ("x", "f"): ("s1", 1), ("x", "h"): ("s3", 1), ("a", "h"): ("s3", 2), ("y", "f"): ("s1", 2), ("y", "h"): ("s3", 2), ("b", "h"): ("s3", 3)}
    assert resolve.resolve_exports(own.limit(0), again).count() == 0


def test_calls_and_heritage(spark):
    own = spark.createDataFrame([("a", "f", "s1"), ("b", "f", "s2"), ("c", "only", "s3")], "module string, name string, symbol string")
    imports = spark.createDataFrame([("z", "f", "b", "f", "s2", "resolved")], "file string, local string, module string, name string, symbol string, resolution string")
    calls = spark.createDataFrame([(1, "a", "f"), (2, "z", "f"), (3, "q", "f"), (4, "q", "only"), (5, "q", None)], "call int, file string, name string")
    got = {r.call: (r.symbol, r.resolution, r.basis) for r in resolve.resolve_calls(calls, own, imports).collect()}
    assert got == {1: ("s1", "resolved", "file"), 2: ("s2", "resolved", "import"), 3: (None, "unresolved", "ambiguous"), 4: ("s3", "partial", "only"), 5: (None, "unresolved", "unknown")}
    kinds = spark.createDataFrame([("s1", "class"), ("s2", "interface"), ("s3", "interface")], "symbol string, kind string")
    clauses = spark.createDataFrame([("z", "s1", "extends", "f"), ("c", "s2", "implements", "only")], "file string, symbol string, keyword string, name string")
    assert sorted((r.src, r.relation, r.dst) for r in resolve.heritage(clauses, own, kinds, imports).collect()) == [("s1", "implements", "s2"), ("s2", "extends", "s3")]


def test_routes_and_paths(spark):
    lines = spark.createDataFrame([("p", 1, "app.get('/a/:id', show)"), ("p", 2, "router.use(`/x/${y}`, mw)"), ("p", 3, "app.post(path, run)"), ("p", 4, "x.get('/no', f)")], "path string, n int, line string")
    assert rows(resolve.express_routes(lines).select("n", "method", "route", "handler", "resolution")) == [(1, "GET", "/a/:id", "show", "resolved"), (2, "USE", None, "mw", "unresolved"), (3, "POST", None, "run", "unresolved")]
    p = spark.createDataFrame([("a/../b",), ("..",), (None,), ("/x",), ("./",)], "p string")
    assert [x[0] for x in p.select(captures.normalized(F.col("p"))).collect()] == ["b", None, None, None, ""]


def test_details_and_states(spark):
    n = nodes(spark, ("k1", "function", "f", None), ("k2", "function", "g", None))
    got = detail.resolve_entity(n, spark.createDataFrame([("k1",), ("zz",)], "query string"))
    assert rows(got.select("query", "status", "node_key")) == [("k1", "ok", "k1"), ("zz", "unknown", None)]
    assert detail.node_detail(n, edges(spark, ("k1", "calls", "k2")), spark.createDataFrame([("k2",)], "query string")).first().fan_in == 1
    e = spark.createDataFrame([(1, 1, 1, "change"), (1, 2, 1, "start"), (1, 3, 2, "change"), (1, 4, 1, "done"), (1, 5, 2, "start"), (1, 6, 2, "done")], "t int, seq int, generation int, kind string")
    assert [x.state for x in detail.refresh_states(e, "t").orderBy("seq").collect()] == ["dirty", "running", "dirty", "obsolete", "running", "settled"]


def test_ladder_fold_and_median(spark):
    df = spark.createDataFrame([(i, 10) for i in range(5)], "k int, c int")
    costs = {"body": F.col("c") * 10, "name": F.col("c")}
    level, got = traverse.budget_ladder(df, [F.asc("k")], costs, 25)
    assert level == "name" and got.count() == 2
    assert traverse.budget_ladder(df, [F.asc("k")], costs, 500)[0] == "body"
    with pytest.raises(ValueError, match="budget"):
        traverse.budget_ladder(df, [F.asc("k")], costs, 9)
    many = spark.createDataFrame([(f"k{i:02}", i) for i in range(21)], "key string, n int")
    assert aggregate.omission_fold(many.where("n < 20"), ["key"]).count() == 20
    folded = {r.key: r.n for r in aggregate.omission_fold(many, ["key"]).collect()}
    assert len(folded) == 20 and folded["other"] == 0 + 1 and sum(folded.values()) == 210
    assert aggregate.omission_fold(many.limit(0), ["key"]).count() == 0
    v = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 4.0), (1, 9.0), (2, 3.0), (2, None)], "g int, v double")
    assert rows(aggregate.median(v, ["g"], "v")) == [(1, 2.5, 4), (2, 3.0, 1)]


def test_posting_index_equals_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "foo_bar baz"), (2, "bar foo"), (3, "Foo Bar"), (4, None), (5, "bar_baz bar")], "id int, name string")
    index = search.PostingIndex.build(df, "id", ["name"], str(tmp_path / "i"))
    for q in ("foo ba", "bar", "foo_ba", "BAZ", "nothing"):
        assert rows(index.search(df, q, ["name"])) == rows(search.search(df, q, "id", ["name"])), q
    assert [x.id for x in index.search(df, "bar", ["name"], F.col("id") > 2).orderBy("id").collect()] == [3, 5]
    assert rows(index.faults(spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "id int"))) == [(5, "orphan"), (9, "missing")]


def test_context_forces_neighbours(spark):
    n = nodes(spark, *[(k, kind, k, None) for k, kind in (("a", "function"), ("b", "function"), ("t", "test"), ("u", "test"), ("c", "file"), ("ty", "type"))])
    e = edges(spark, ("b", "calls", "a"), ("t", "tests", "a"), ("b", "imports", "c"))
    got = {r.node: (r.hop, r.priority) for r in traverse.context(e, n, node_frame(spark, "a"), 2, ("imports",), node_frame(spark, "ty")).collect()}
    assert got == {"b": (1, 2), "t": (1, 2), "c": (2, 0), "ty": (1, 2)}


def test_region_faults_of_a_sound_replacement(spark):
    f = spark.createDataFrame([("a", "go"), ("b", "go")], "path string, language string")
    n = spark.createDataFrame([("k", "method", "a")], "node_key string, kind string, file string")
    assert store.region_faults(f, f.where("path = 'a'"), f.where("path = 'a'").select("path"), n, n).count() == 0


def test_changed_inputs_are_published_anew(spark, tmp_path):
    from tessera.sources import testdata

    for name in testdata._READ:
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = testdata.published(spark, str(tmp_path))[0].where("kind = 'function'").count()
    stores = len(testdata._STORES)
    testdata.published(spark, str(tmp_path))
    assert len(testdata._STORES) == stores
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(5).withColumn("p_partkey", F.col("p_partkey") + 10**6).write.mode("append").parquet(f"{tmp_path}/part.parquet")
    assert testdata.published(spark, str(tmp_path))[0].where("kind = 'function'").count() == before + 5
    assert len(testdata._STORES) == stores + 1


def test_edges_are_shuffled_and_stored_without_digests(spark, tmp_path):
    from tessera import model
    from tessera.operators import store
    from tessera.sources import testdata

    plan = testdata.edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src" not in plan and "hashpartitioning(dst" not in plan
    n = spark.createDataFrame([("file", "a|b"), ("test", "t")], "kind string, qualified_name string")
    n = n.select(model.node_key(F.col("kind"), F.col("qualified_name")).alias("node_key"), "*")
    e = spark.createDataFrame([("test", "t", "tests", "file", "a|b", "human")], "src_kind string, src_name string, relation string, dst_kind string, dst_name string, origin string")
    s = store.NamedStore(spark, str(tmp_path / "named"))
    assert s.publish(n, e, "A", None) == 1
    assert "src" not in spark.read.parquet(f"{tmp_path}/named/edges").columns
    keys = {x.kind: x.node_key for x in s.read("nodes", 1).collect()}
    got = s.read("edges", 1).first()
    assert (got.src, got.dst, got.relation, got.origin) == (keys["test"], keys["file"], "tests", "human")
    assert s.read("edges", 1).where(F.col("edge_key") == model.edge_key(F.col("src"), F.col("relation"), F.col("dst"))).count() == 1
    with pytest.raises(ValueError, match="dangling"):
        s.publish(n.where("kind = 'file'"), e, "B", 1)


def test_steps_of_walks_are_compressed_well(spark):
    """Digests are half as long under zstd."""
    import glob

    from tessera.functions.shared import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{root}/steps-*"))
    got = traverse.reach(node_frame(spark, "a"), spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"))
    assert {x.node: x.hop for x in got.collect()} == {"a": 0, "b": 1, "c": 2}
    new = [f for d in set(glob.glob(f"{root}/steps-*")) - before for f in glob.glob(f"{d}/*.parquet")]
    assert new and all(".zstd." in f for f in new)


def test_folders_are_looked_up_once_each(spark):
    """Roots come by folder, so no file is multiplied by its depth and no aggregate with a name is kept by path."""
    f = spark.createDataFrame([("x.py", "python"), ("a/b/y.py", "python"), ("a/b/y.py", "python"), ("a/b/z.go", "go"), ("a/b", "go"), ("/abs", "go"), (None, "go"), ("a/n", None)], "path string, language string")
    p = spark.createDataFrame([(".", ["python"]), ("a", ["go"]), ("a/b", ["python"]), ("", ["go"])], "root string, languages array<string>")
    got = resolve.with_projects(f, p)
    assert sorted(map(str, got.collect())) == sorted(f"Row(path={a!r}, language={b!r}, project={c!r})" for a, b, c in [("x.py", "python", "."), ("a/b/y.py", "python", "a/b"), ("a/b/y.py", "python", "a/b"), ("a/b/z.go", "go", "a"), ("a/b", "go", "a"), ("/abs", "go", ""), (None, "go", None), ("a/n", None, None)])
    m = spark.createDataFrame([("", "root"), ("a/b", "deep"), ("a", None)], "folder string, name string")
    near = captures.nearest_manifest(f, m)
    assert {x.path: x.package for x in near.collect()} == {"x.py": "root", "a/b/y.py": "deep", "a/b/z.go": "deep", "a/b": "root", "/abs": "root", "a/n": "root"}
    for df in (got, near):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "max_by" in line and "keys=[path" in line]


def test_linked_tests_in_a_fixed_number_of_parts(spark):
    tests = spark.range(300).select(F.concat(F.lit("t"), "id").alias("test"), F.concat(F.lit("covers part"), F.col("id") % 7, F.lit(" and part"), "id").alias("title"))
    calls = spark.range(0, 300, 3).select(F.concat(F.lit("t"), "id").alias("test"), F.lit("s").alias("symbol"))
    symbols = spark.range(20).select(F.concat(F.lit("p"), "id").alias("symbol"), F.concat(F.lit("part"), "id").alias("display_name"))
    symbols = symbols.unionByName(spark.createDataFrame([("c", "covers"), ("d", "part19")], "symbol string, display_name string"))
    frame = resolve.linked_tests(tests, calls, symbols)
    got = sorted(tuple(x) for x in frame.collect())
    want = {(f"t{i}", "s", "compiler", "certain") for i in range(0, 300, 3)}
    for i in (i for i in range(300) if i % 3):
        want |= {(f"t{i}", s, "heuristic", "inferred") for s in ("c", f"p{i % 7}", *[f"p{i}"] * (i < 19))}
    assert got == sorted(want)
    assert frame.rdd.getNumPartitions() >= 4  # not merged into one task because the rows are few or compress well


def test_frequent_words_give_the_same_links(spark):
    tests = spark.range(100).select(F.concat(F.lit("t"), "id").alias("test"), F.concat(F.lit("covers and part"), F.col("id") % 5).alias("title"))
    calls = spark.createDataFrame([("t1", "s")], "test string, symbol string")
    symbols = spark.createDataFrame([("c", "covers"), ("a", "and"), ("b", "and"), ("p1", "part1"), ("p2", "part2")], "symbol string, display_name string")
    rows = lambda often: sorted(tuple(x) for x in resolve.linked_tests(tests, calls, symbols, often).collect())
    assert rows(30) == rows(1) == rows(1000)
    assert len(rows(30)) == 1 + 99 + 19 + 20
