"""Micro graphs for the operators."""

import hashlib
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

from tessera import model
from tessera.operators import aggregate, diff, intervals, project, review, search, store, textlines, traverse
from tessera.sources import captures

EDGE = "edge_key string, src string, relation string, dst string, origin string, confidence string, resolution string"
NODE = "node_key string, kind string, qualified_name string, display_name string, file string, package string, language string"


def edges(spark, *rows):
    full = [(r[3] if len(r) > 3 else f"{r[0]}>{r[1]}>{r[2]}", r[0], r[1], r[2], *(r[4:] or ("compiler", "certain", "resolved"))) for r in rows]
    return spark.createDataFrame(full, EDGE)


def nodes(spark, *rows):
    return spark.createDataFrame([(k, kind, k, k, f, p, "x") for k, kind, f, p in rows], NODE)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def node_frame(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_identity_escapes(spark):
    df = spark.createDataFrame([("a|b", "c\\d")], "a string, b string")
    got = df.select(model.identity("node", F.col("a"), F.col("b"))).first()[0]
    assert got == hashlib.sha256(rb"node|a\|b|c\\d").hexdigest()


def test_strongest_claim_unites_evidence(spark):
    df = spark.createDataFrame([("e", "heuristic", "likely", "resolved", ["x"]), ("e", "compiler", "certain", "unresolved", ["y", "x"]), ("f", "git", "inferred", "partial", [])], "k string, origin string, confidence string, resolution string, evidence array<string>")
    assert rows(model.strongest_claims(df, ["k"], "evidence")) == [("e", "compiler", "certain", "unresolved", 2, ["x", "y"]), ("f", "git", "inferred", "partial", 1, [])]


def test_ownership_ties_and_nesting(spark):
    n = nodes(spark, ("p", "package", None, None), ("q", "package", None, None), ("r", "package", None, None), ("x", "file", "x", None), ("y", "file", "y", None), ("z", "file", "z", None))
    e = edges(spark, ("p", "contains", "x"), ("q", "contains", "x"), ("p", "contains", "r"), ("r", "contains", "y"), ("p", "contains", "y2"), ("y", "calls", "x"), ("p", "imports", "y"))
    own = project.ownership(n, e)
    assert rows(own) == [("p", "p", 0, "owned"), ("q", "q", 0, "owned"), ("r", "r", 0, "owned"), ("x", None, 1, "ambiguous"), ("y", "r", 1, "owned"), ("z", None, None, "unowned")]
    assert [x[:4] for x in rows(project.package_edges(e, own))] == [("p", "r", "contains", 1), ("p", "r", "imports", 1)]
    acc = project.ownership_accounts(e, own).first()
    assert (acc.n_candidates, acc.n_projected, acc.n_ambiguous, acc.n_unowned) == (7, 2, 1, 1)


def test_three_way_diff_ignores_evidence(spark):
    base = edges(spark, ("a", "calls", "b"), ("a", "calls", "c"), ("a", "calls", "d"))
    head = edges(spark, ("a", "calls", "c"), ("a", "calls", "d", "a>calls>d", "heuristic", "likely", "resolved"), ("a", "calls", "e"))
    assert [(x.edge_key, x.change, x.before_origin, x.after_origin) for x in diff.edge_diff(base.withColumn("evidence", F.lit(1)), head.withColumn("evidence", F.lit(2))).orderBy("edge_key").collect()] == [("a>calls>b", "removed", "compiler", None), ("a>calls>d", "changed", "compiler", "heuristic"), ("a>calls>e", "added", None, "compiler")]
    assert diff.edge_diff(base, base).count() == 0


def test_renames(spark):
    schema = "id string, body string, name string"
    removed = spark.createDataFrame([("r1", "h1", "m"), ("r2", "h2", "old"), ("r3", "h3", "u"), ("r4", "h3", "v"), ("r5", None, "n"), ("r6", "h6", "w"), ("r7", "h6", "w")], schema)
    added = spark.createDataFrame([("a1", "h1", "m"), ("a2", "h2", "new"), ("a3", "h3", "x"), ("a5", None, "n"), ("a6", "h6", "w")], schema)
    assert rows(diff.rename_pairs(removed, added, "name", ["body"])) == [("r1", "a1", "A"), ("r2", "a2", "B")]
    left, right = diff.residual(removed, added, "name", ["body"])
    assert rows(diff.ambiguous_groups(left, right, ["body"])) == [("h3", 2, 1), ("h6", 2, 1)]
    pairs = spark.createDataFrame([("o1", "n1"), ("o2", "n2")], "removed_id string, added_id string")
    gone = edges(spark, ("o1", "calls", "x", "r1"), ("o1", "calls", "x", "r2"), ("o2", "calls", "o1", "r3"), ("x", "calls", "y", "r4"))
    come = edges(spark, ("n1", "calls", "x", "a1"), ("n2", "calls", "n1", "a2"), ("x", "calls", "y", "a3"))
    assert rows(diff.coalesce_edges(gone, come, pairs)) == [("r1", "a1"), ("r3", "a2")]


def test_paging_across_lists(spark):
    a, b = spark.createDataFrame([("k2",), ("k1",)], "k string"), spark.createDataFrame([("k0",), ("k9",)], "k string")
    assert rows(diff.paged([("x", a), ("y", b)], "k", 1, 2)) == [("x", "k2"), ("y", "k0")]


def test_paths_cycles_and_limits(spark):
    e = edges(spark, ("a", "calls", "b", "e1"), ("b", "calls", "a", "e2"), ("a", "calls", "b", "e3"), ("b", "imports", "c", "e4"), ("a", "calls", "c", "e9"), ("c", "tests", "d", "e5"))
    got = traverse.k_paths(e, node_frame(spark, "a"), node_frame(spark, "c"), 5)
    assert [(x.rank, x.edge_keys, x.status) for x in got.orderBy("rank").collect()] == [(1, ["e9"], "ok"), (2, ["e1", "e4"], "ok"), (3, ["e3", "e4"], "ok")]
    assert [x.n_edges for x in traverse.k_paths(e, node_frame(spark, "a"), node_frame(spark, "a"), 2).collect()] == [0]
    assert rows(traverse.k_paths(e, node_frame(spark, "c"), node_frame(spark, "a"), 2)) == [("no_path", None, None, None, None)]
    assert traverse.k_paths(e, node_frame(spark, "a"), node_frame(spark, "d"), 1, most_edges=1).first().status == "search_limit"
    assert traverse.k_paths(e, node_frame(spark, "a"), node_frame(spark, "d"), 1, most_rows=1).first().status == "search_limit"
    # c is one edge away, but the longest way that was found has two
    assert rows(traverse.nearest_approach(e, node_frame(spark, "a"), node_frame(spark, "d"))) == [("a", 0, None), ("b", 1, None), ("c", 2, None)]
    assert rows(traverse.nearest_approach(e, node_frame(spark, "a"), node_frame(spark, "b"))) == []
    chain = edges(spark, *[(f"n{i}", "calls", f"n{i + 1}") for i in range(6)])
    assert [x[0] for x in traverse.nearest_approach(chain, node_frame(spark, "n0"), node_frame(spark, "n6"), most_edges=2).collect()] == ["n2", "n1", "n0"]


def test_impact_depths(spark):
    chain = [(f"f{i}", "imports", f"f{i + 1}") for i in range(5)]
    e = edges(spark, *chain, ("t", "tests", "f4"))
    n = nodes(spark, *[(f"f{i}", "file", f"f{i}", f"p{i}") for i in range(6)], ("t", "test", "t", "p0"))
    for depth in (1, 2, 3):
        hit = traverse.impact(e, node_frame(spark, "f5"), depth)
        assert rows(hit) == [(f"f{5 - d}", d) for d in range(depth, -1, -1)]
        assert rows(traverse.beyond_depth(e, hit, n, depth)) == [(f"p{4 - depth}", 1)]
        assert rows(traverse.impact_tests(e, hit, n)) == [("t", 1)]
    assert [x[0] for x in rows(traverse.find_tests(e, n, node_frame(spark, "f4")))] == ["f4"]


def test_context_and_budget(spark):
    e = edges(spark, ("a", "calls", "b"), ("c", "imports", "a"), ("t", "tests", "a", "t>a", "heuristic", "likely", "partial"), ("b", "calls", "d"))
    n = nodes(spark, ("a", "method", "f", "p"), ("b", "method", "f", "p"), ("c", "file", "c", "q"), ("t", "test", "t", "p"), ("d", "method", "g", None))
    got = {x.node: x for x in traverse.context(e, n, node_frame(spark, "a"), 2).collect()}
    assert {k: (x.hop, x.priority) for k, x in got.items()} == {"b": (1, 2), "c": (1, 0), "t": (1, 0), "d": (2, 0)}
    assert got["t"].score == pytest.approx(2.5 / 2 + 1.5 + 0.5) and got["d"].score == pytest.approx(2.5 / 3 + 0.693147, abs=1e-5)
    df = spark.createDataFrame([(1, 5), (2, 4), (3, 3)], "k int, c int")
    assert rows(traverse.within_budget(df, [F.asc("k")], F.col("c"), 9)) == [(1, 5, 5, 5), (2, 4, 4, 9)]


def test_story_labels(spark):
    e = edges(spark, ("r", "routes_to", "h"), ("h", "calls", "x", "u", "compiler", "certain", "unresolved"), ("x", "calls", "never"), ("h", "calls", "y", "v", "heuristic", "likely", "partial"), ("h", "calls", "z"), ("t", "tests", "z"), ("z", "calls", "h"))
    assert {(x.edge_key, x.label) for x in traverse.story(e, node_frame(spark, "r")).collect()} == {("r>routes_to>h", "statically-resolved"), ("u", "unresolved"), ("v", "ambiguous"), ("h>calls>z", "test-backed"), ("z>calls>h", "statically-resolved")}


def test_search_phrases_and_statistics(spark):
    df = spark.createDataFrame([(1, "foo_bar"), (2, "bar foo"), (3, "fooBar"), (4, "café"), (5, "foo bar baz"), (6, None)], "id int, name string")
    hits = lambda q, d=df: [x.id for x in search.search(d, q, "id", ["name"]).collect()]
    assert hits("foo_ba") == [1, 5] or hits("foo_ba") == [5, 1]
    assert set(hits("foo bar")) == {1, 2, 5} and hits("foobar") == [3] and hits("CAFE") == [4] and hits("--") == [] and hits("café") == [4]
    assert hits("Bar Foo")[0] == 2
    more = df.union(spark.createDataFrame([(i, "other words") for i in range(7, 60)], "id int, name string"))
    score = lambda d: search.search(d, "bar", "id", ["name"]).first().score
    assert score(more) > score(df)  # corpus statistics span all rows


def test_rules(spark):
    rules = review.parse_rules('{"boundaries": [{"id": "r", "from": "src/**/a*.ts", "deny": ["lib/*", "x"]}]}')
    n = nodes(spark, ("f", "file", "src/a1.ts", None), ("m", "method", "src/q/r/a.ts", None), ("g", "file", "lib/b.ts", None), ("h", "file", "lib/c/d.ts", None))
    e = edges(spark, ("f", "calls", "g"), ("f", "imports", "g"), ("m", "calls", "g"), ("f", "imports", "h"), ("m", "tests", "g"))
    assert rows(review.violations(e, n, rules).drop("evidence", "n_edges")) == [("r", "error", "file:src/a1.ts", "imports", "file:lib/b.ts"), ("r", "error", "file:src/q/r/a.ts", "calls", "file:lib/b.ts")]
    for bad, field in (('{"boundaries": {}}', "boundaries"), ('{"boundaries": [{"id": "r", "from": "a", "deny": "b"}]}', r"boundaries\[0\].deny"), ('{"boundaries": [{"id": 1, "from": "a", "deny": []}]}', r"boundaries\[0\].id")):
        with pytest.raises(ValueError, match=field):
            review.parse_rules(bad)


def test_co_change(spark):
    log = spark.createDataFrame([("commit:s1\n\na.ts\nb.ts\n\ncommit:s2\n\nb.ts\na.ts\nc.ts\n",)], "text string")
    files = captures.commit_files(log)
    assert rows(files)[:2] == [("s1", 0, "a.ts"), ("s1", 0, "b.ts")]
    assert rows(review.co_change(files)) == [("a.ts", "b.ts", 2, "s1")]


def test_overlay_and_matches(spark):
    f = lambda *x: spark.createDataFrame([(i,) for i in x], "file string")
    got = {x.file: x for x in review.observation_overlay(f("a", "b"), f("b"), f("b", "c"), f("c")).collect()}
    assert got["a"].planned_not_modified and got["c"].modified_not_retrieved and got["c"].modified_not_planned and not got["b"].modified_not_retrieved
    p = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, name string")
    c = spark.createDataFrame([("x", "c1"), ("y", "c2"), ("y", "c3")], "name string, candidate string")
    assert rows(review.unique_match(p, c, "name")) == [(1, "x", "c1", "matched"), (2, "y", None, "ambiguous"), (3, "z", None, "none")]


def test_intervals(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 50), ("f", "inner", 10, 20), ("g", "other", 1, 5)], "file string, node string, s_start int, s_end int")
    points = spark.createDataFrame([("f", 1, 15), ("f", 2, 30), ("g", 3, 6)], "file string, point int, at int")
    assert rows(intervals.enclosing(points, spans)) == [("f", 1, "inner"), ("f", 2, "outer")]
    hunks = spark.createDataFrame([("f", 20, 22)], "file string, h_start int, h_end int")
    assert [x.node for x in intervals.overlaps(hunks, spans).orderBy("node").collect()] == ["inner", "outer"]


def test_debounce(spark):
    ms = [0, 50, 100, 175, 251, 400, *range(1000, 1601, 50)]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(ms)], "event_id int, task int, ms int").withColumn("ts", F.timestamp_millis("ms"))
    got = review.debounce(df, "task", "0.075 SECONDS", "0.5 SECONDS").orderBy("start").collect()
    # 175 to 251 is over the quiet time; the long run is cut 500 ms after its first event, and again from the next one on
    assert [x.n_events for x in got] == [4, 1, 1, 11, 2]


def test_text_extractors(spark):
    md = spark.createDataFrame([(1, "# A\ntext `x()` and `a/b.ts`\n## B\n### C\n## D\n# E\n#no")], "id int, t string")
    assert [tuple(x)[1:] for x in textlines.markdown_sections(md, "id", "t").orderBy("n").collect()] == [(1, 1, "A", None), (3, 2, "B", 1), (4, 3, "C", 3), (5, 2, "D", 1), (6, 1, "E", None)]
    terms = textlines.backtick_terms(md, "id", "t")
    assert rows(terms) == [(1, 2, "a/b.ts"), (1, 2, "x()")]
    sym = spark.createDataFrame([("x()", "k1")], "display_name string, node_key string")
    path = spark.createDataFrame([("a/b.ts", "k2")], "path string, node_key string")
    assert rows(textlines.doc_links(terms, sym, path)) == [(1, 2, "certain", "a/b.ts", "k2")]
    d = spark.createDataFrame([(1, "--- a/x.ts\n+++ b/x.ts\n@@ -1,2 +3,4 @@\n a\n@@ -9 +10,0 @@\n-b\n--- a/y.ts\n+++ /dev/null\n@@ -1,3 +0,0 @@\n")], "id int, t string")
    assert rows(textlines.diff_hunks(d, "id", "t").select("file", "h_start", "h_end")) == [("x.ts", 3, 6), ("x.ts", 9, 9), ("y.ts", 1, 3)]
    p = spark.createDataFrame([("src/app/page.tsx",), ("app/(g)/user/[id]/route.ts",), ("app/x.ts",)], "path string")
    assert [x[0] for x in p.select(textlines.next_route(F.col("path"))).collect()] == ["/", "/user/[id]", None]


def test_scan(spark, tmp_path):
    for name, data in {"a/x.py": b"print(1)", "node_modules/y.js": b"x", "b/z.bin": b"a\x00b", "gen/q.ts": b"1", "big.md": b"#" * 200, "p0.txt": b"\x50\x05"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = captures.scan(captures.captured(spark, f"file://{tmp_path}"), ["gen/"], most_bytes=100)
    assert [(x.path, x.reason) for x in got.orderBy("path").collect()] == [("a/x.py", None), ("b/z.bin", "binary"), ("big.md", "too_large"), ("gen/q.ts", "ignored"), ("node_modules/y.js", "excluded"), ("p0.txt", None)]
    df = spark.createDataFrame([("a/Dockerfile", ""), ("x.tsx", ""), ("run", "#!/usr/bin/env python3"), ("run2", "x")], "p string, l string")
    assert [x[0] for x in df.select(captures.language(F.col("p"), F.col("l"))).collect()] == ["dockerfile", "typescript", "python", None]
    m = spark.createDataFrame([("", "root"), ("a", None), ("a/b", "inner")], "folder string, name string")
    f = spark.createDataFrame([("a/b/c.ts",), ("a/d.ts",)], "path string")
    assert rows(captures.nearest_manifest(f, m)) == [("a/b/c.ts", "inner"), ("a/d.ts", "root")]


def test_store(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "store"))
    n, e = nodes(spark, ("a", "file", "a", None), ("b", "file", "b", None)), edges(spark, ("a", "imports", "b"))
    assert s.publish(n, e, "A", None) == 1
    assert s.publish(n.where("node_key = 'a'"), e.limit(0), "B", 1) == 2
    assert s.publish(n, e, "A", 2) == 1 and s.head() == (3, 1)  # A, B, A reuses the first snapshot
    with pytest.raises(store.Conflict):
        s.publish(n, e, "C", 1)
    with pytest.raises(ValueError, match="dangling"):
        s.publish(n.where("node_key = 'a'"), e, "D", 3)
    assert s.head() == (3, 1) and s.read("edges", 1).count() == 1
    with pytest.raises(ValueError):
        s.prune(1)
    with pytest.raises(ValueError, match="task"):
        s.prune(2, active=(2,))
    with pytest.raises(store.Conflict):
        s._activate({"activation_id": 3, "snapshot_id": 9, "workspace_hash": "Z", "previous": 1})  # a writer that saw the head before
    s.prune(2)
    assert s.read("nodes", 1).count() == 2 and s.read("nodes", 2).count() == 0 and s.activations().count() == 3


def test_region_merge_equals_full(spark):
    n = nodes(spark, ("a", "file", "a", None), ("b", "file", "b", None), ("ext", "external_dep", None, None), ("ext2", "external_dep", None, None))
    e = edges(spark, ("a", "imports", "b"), ("b", "imports", "ext"), ("b", "calls", "a"))
    nn = nodes(spark, ("b", "file", "b", None))
    ne = edges(spark, ("b", "imports", "ext2"), ("b", "calls", "a", "x", "heuristic", "likely", "partial"))
    got_n, got_e = store.merge_region(n, e, nn, ne, spark.createDataFrame([("b",)], "file string"))
    assert [x[0] for x in rows(got_n.select("node_key"))] == ["a", "b", "ext2"]
    assert rows(got_e.select("src", "relation", "dst", "confidence")) == [("a", "imports", "b", "certain"), ("b", "calls", "a", "likely"), ("b", "imports", "ext2", "certain")]
    assert model.dangling(got_e, got_n).count() == 0


def test_upsert_counts_collisions(spark):
    known = spark.createDataFrame([("k", "i0", 0)], "key string, ident string, collision_index int")
    new = spark.createDataFrame([("k", "i0"), ("k", "i1"), ("m", "i2"), ("m", "i2")], "key string, ident string")
    got = {x.ident: (x.key, x.collision_index) for x in store.stable_upsert(known, new, "key", "ident").collect()}
    assert got == {"i0": ("k", 0), "i1": (hashlib.sha256(b"i1|1").hexdigest(), 1), "i2": ("m", 0)}


def test_freshness(spark):
    pair = "path string, hash string"
    got = store.freshness(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], pair), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], pair))
    assert rows(got) == [("a", "fresh"), ("b", "stale"), ("c", "stale"), ("d", "unknown")]
    of = spark.createDataFrame([("n1", "a"), ("n1", "d"), ("n2", "a"), ("n3", "b"), ("n3", "d")], "node string, path string")
    assert rows(store.worst_freshness(got, of, "node")) == [("n1", "unknown"), ("n2", "fresh"), ("n3", "stale")]


def test_aggregates(spark):
    v = spark.createDataFrame([("x", i) for i in range(1, 21)] + [("y", 5)], "g string, v int")
    assert rows(aggregate.nearest_rank(v, ["g"], "v", 0.95)) == [("x", 19, 20), ("y", 5, 1)]
    om = spark.createDataFrame([(f"k{i:02}", 100 - i) for i in range(21)], "k string, n int")
    got = rows(aggregate.omission_fold(om, ["k"]))
    assert len(got) == 20 and ("other", 81 + 80) in got
    assert len(rows(aggregate.omission_fold(om.limit(20), ["k"]))) == 20
    e = edges(spark, ("a", "calls", "b"), ("a", "contains", "b"))
    assert dict(rows(aggregate.relation_histogram(e)))["tests"] == 0 and rows(aggregate.fan_in(e)) == [("b", 1)]
    a = aggregate.set_digest(v, ["g", "v"]).first()
    assert a == aggregate.set_digest(v.orderBy(F.desc("v")), ["g", "v"]).first() and a.n_rows == 21


def test_longest_prefix(spark):
    p = spark.createDataFrame([("a/b/c.ts",), ("ab/c.ts",), ("a",)], "path string")
    r = spark.createDataFrame([(".",), ("a",), ("a/b",)], "root string")
    assert rows(project.longest_prefix(p, r)) == [("a", "a"), ("a/b/c.ts", "a/b"), ("ab/c.ts", ".")]


def test_reach_on_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert rows(traverse.reach(node_frame(spark, "a"), e)) == [("a", 0), ("b", 1), ("c", 2)]


@pytest.mark.parametrize("walk", [traverse.reach, traverse.reach_from])
def test_reach_has_no_bound(spark, monkeypatch, walk):
    """A stand-in frame has something new for 300 levels; a real chain of that length takes minutes."""
    frame = MagicMock()
    frame.unionByName.return_value = frame
    frame.isEmpty.side_effect = [False] * 300 + [True]
    monkeypatch.setattr(traverse, "materialize", lambda df, name: frame)
    walk(frame, frame)
    assert frame.isEmpty.call_count == 301


def test_within_budget_takes_all_that_fits(spark):
    assert traverse.within_budget(spark.range(10_100), [F.asc("id")], F.lit(1), 10_050).count() == 10_050


def test_walk_over_a_long_chain(spark):
    chain = spark.range(230).select(F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst")).coalesce(1)
    got = traverse.reach(node_frame(spark, "n190"), chain)
    assert got.count() == 41 and got.agg(F.max("hop")).first()[0] == 40
