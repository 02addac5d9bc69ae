from tessera.operators import containment, dispatch, project

NODES = "node_key string, kind string, qualified_name string, display_name string, file string"
EDGES = "edge_key string, src string, relation string, dst string"
PROJECTS = "project_id string, root string, name string, manifest string, languages array<string>"


def tree(spark, files, packages, holds, projects):
    nodes = spark.createDataFrame([(f, "file", f, f, f) for f in files] + [(p, "package", p, p, None) for p in packages], NODES)
    return nodes, spark.createDataFrame([(f"{a}>{b}", a, "contains", b) for a, b in holds], EDGES), spark.createDataFrame(projects, PROJECTS)


def test_roots_own_their_files_once(spark):
    files = ["x.md", "a/1", "a/b/2", "a/b/go.mod", "a/bc/3", "d/4"]
    holds = [("repo", f) for f in files] + [("lib", "d/4"), ("svc", "a/b/2")]
    projects = [("1", ".", None, None, ["go"]), ("2", "a", "tool", None, ["go", "ts"]), ("3", "a/b", "svc", "a/b/go.mod", ["go"]), ("4", "a/b", None, None, ["go"]), ("5", "d", "lost", "d/none", [])]
    nodes, edges, projects = tree(spark, files, ["repo", "lib", "svc"], holds, projects)
    packages, homes = containment.project_packages(nodes, edges, projects, "repo")
    got = {r.root: r for r in packages.collect()}
    assert {r: (x.is_new, x.display_name, x.language, x.evidence) for r, x in got.items()} == {
        ".": (False, None, None, "x.md"), "a": (True, "tool", None, "a/1"), "a/b": (False, None, None, "a/b/go.mod"), "d": (True, "lost", None, "d/4")}
    assert got["a/b"].package == "svc" and got["."].package == "repo"
    assert {r.file: r.root for r in homes.collect()} == {"x.md": ".", "a/1": "a", "a/b/2": "a/b", "a/b/go.mod": "a/b", "a/bc/3": "a", "d/4": "d"}
    changes = containment.containment_changes(nodes, edges, packages, homes)
    name = {x.package: r for r, x in got.items()}
    assert sorted((r.change, name.get(r.src, r.src), name.get(r.dst, r.dst)) for r in changes.collect()) == [
        ("added", ".", "a"), ("added", ".", "d"), ("added", "a", "a/1"), ("added", "a", "a/b"), ("added", "a", "a/bc/3"), ("added", "a/b", "a/b/go.mod"), ("added", "d", "lib"),
        ("removed", ".", "a/1"), ("removed", ".", "a/b/2"), ("removed", ".", "a/b/go.mod"), ("removed", ".", "a/bc/3"), ("removed", ".", "d/4")]
    n, e = containment.apply_changes(nodes, edges, packages, changes)
    owners = {r.node_key: (name.get(r.owner, r.owner), r.status) for r in project.ownership(n, e).collect()}
    assert {f: owners[f] for f in files} == {"x.md": (".", "owned"), "a/1": ("a", "owned"), "a/b/2": ("a/b", "owned"), "a/b/go.mod": ("a/b", "owned"), "a/bc/3": ("a", "owned"), "d/4": ("lib", "owned")}
    # a second run has nothing to do
    again, homes = containment.project_packages(n, e, projects, "repo")
    assert containment.containment_changes(n, e, again.where("NOT is_new"), homes).where("src IN ('repo', 'svc')").count() == 0


def test_no_projects_and_a_root_package_without_a_project(spark):
    nodes, edges, projects = tree(spark, ["a/1"], ["repo"], [("repo", "a/1")], [("1", "a", None, None, ["go"])])
    packages, homes = containment.project_packages(nodes, edges, projects, "repo")
    assert sorted((r.root, r.is_new, r.language) for r in packages.collect()) == [(".", False, None), ("a", True, "go")]
    assert sorted(r.change for r in containment.containment_changes(nodes, edges, packages, homes).collect()) == ["added", "added", "removed"]
    packages, homes = containment.project_packages(nodes, edges, projects.limit(0))
    assert packages.count() == 0 and containment.containment_changes(nodes, edges, packages, homes).count() == 0


def test_candidates_by_arity(spark):
    declared = spark.createDataFrame([("s1", "method", "run", 1, 2), ("s1", "method", "run", 4, None), ("s2", "function", "run", 2, 2), ("s3", "class", "run", 0, 9), ("s4", "function", "any", None, None)], "symbol string, kind string, name string, min_args int, max_args int")
    calls = spark.createDataFrame([(1, "c", "run", 1), (2, "c", "run", 2), (3, "c", "run", 3), (4, "c", "run", 7), (5, "c", "any", 5), (6, "c", None, 0), (6, "c", None, 0)], "call int, caller string, name string, n_args int")
    got = sorted((r.call, r.target, r.n_candidates, r.resolution) for r in dispatch.calls_by_arity(calls, declared).collect())
    assert got == [(1, "s1", 1, "partial"), (2, None, 2, "unresolved"), (3, None, 0, "unresolved"), (4, "s1", 1, "partial"), (5, "s4", 1, "partial"), (6, None, 0, "unresolved"), (6, None, 0, "unresolved")]
    assert dispatch.calls_by_arity(calls, declared.limit(0)).where("target IS NOT NULL").count() == 0


def test_computed_calls_share_a_node_in_a_file(spark):
    computed = spark.createDataFrame([("f", "c1", "h[k]", 9), ("f", "c1", "h[k]", 4), ("f", "c2", "h[k]", 6), ("g", "c2", "h[k]", 1)], "file string, caller string, label string, line long")
    nodes = dispatch.unresolved_nodes(computed)
    assert sorted((r.qualified_name, r.line) for r in nodes.collect()) == [("f::<unresolved h[k]>", 4), ("g::<unresolved h[k]>", 1)]
    assert sorted((r.relation, r.resolution, r.n_sites, r.line) for r in dispatch.unresolved_edges(computed, nodes).collect()) == [("calls", "unresolved", 1, 1), ("calls", "unresolved", 1, 6), ("calls", "unresolved", 2, 4), ("contains", "resolved", 1, 1), ("contains", "resolved", 1, 4)]
