"""Walks over edges: level loops whose frames end in the shared folder after every level."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import materialize, packed


def reach(roots: DataFrame, steps: DataFrame, depth: int | None = None) -> DataFrame:
    """Breadth-first: roots (node) and steps (src -> dst) give node, hop (least). depth None: until nothing is new."""
    steps = packed(steps.select("src", "dst"), "steps")  # every level reads them
    seen = materialize(roots.select("node").distinct().withColumn("hop", F.lit(0)), "reach")
    front = seen
    for hop in count(1) if depth is None else range(1, depth + 1):
        new = front.join(steps, front["node"] == steps["src"]).select(F.col("dst").alias("node")).distinct()
        front = materialize(new.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % 32 == 0:
            seen = materialize(seen, "reach")  # a long walk keeps a short plan
    return seen


def reach_from(roots: DataFrame, steps: DataFrame) -> DataFrame:
    """As reach, for each root on its own: root, node, hop."""
    steps = packed(steps.select("src", "dst"), "steps")
    seen = materialize(roots.select(F.col("node").alias("root"), "node").distinct().withColumn("hop", F.lit(0)), "reach")
    front = seen
    for hop in count(1):
        new = front.join(steps, front["node"] == steps["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = materialize(new.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("hop", F.lit(hop)), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % 32 == 0:
            seen = materialize(seen, "reach")  # a long walk keeps a short plan
    return seen


def impact(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Dependents by incoming calls and imports; hop is the least distance."""
    back = edges.where("relation IN ('calls', 'imports')").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(roots, back, depth)


def impact_tests(edges: DataFrame, reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tests linked, either way, with a reached node: test and the number of nodes it covers."""
    tests = nodes.where("kind = 'test'").select(F.col("node_key").alias("test"))
    link = edges.where("relation = 'tests'")
    both = link.select(F.col("src").alias("test"), F.col("dst").alias("node")).union(link.select(F.col("dst"), F.col("src")))
    return both.join(reached.select("node"), "node").join(tests, "test").distinct().groupBy("test").agg(F.count("*").alias("n_covered"))


def beyond_depth(edges: DataFrame, reached: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Unreached sources of incoming calls and imports at the last level, per declared package."""
    last = reached.where(F.col("hop") == depth).select(F.col("node").alias("dst"))
    more = edges.where("relation IN ('calls', 'imports')").join(last, "dst").select(F.col("src").alias("node")).distinct().join(reached.select("node"), "node", "left_anti")
    return more.join(nodes.select(F.col("node_key").alias("node"), "package"), "node").groupBy(F.coalesce("package", F.lit("(unassigned)")).alias("package")).agg(F.count("*").alias("n_beyond"))


@dataclass(frozen=True)
class PathSearch:
    """status: ok, search_limit or no_path. paths: rank, n_edges, edge_keys, nodes. reached: node, from_source (the longest simple path that was found to it)."""

    status: str
    paths: DataFrame
    reached: DataFrame


def path_search(edges: DataFrame, source: DataFrame, target: DataFrame, k: int = 3, most_edges: int = 64, most_rows: int | None = 50_000, relations=("calls", "imports"), key: Column | None = None) -> PathSearch:
    """The first k simple directed paths by (edges, edge keys in sequence).

    Paths grow level by level and end at the target; parallel edges give different paths. Paths of
    most_edges edges that could grow, or more than most_rows paths grown, limit the search (None: no number does).
    The search goes by nodes from which the target is reached; only where that finds nothing, paths to
    all others grow as well, for the status and the nodes reached. key: edge_key by src, relation and dst, where edges have none.
    """
    use = edges.where(F.col("relation").isin(*relations))
    pairs = packed(use.select("src", "dst", "relation") if key is not None else use.select("src", "dst", "relation", "edge_key"), "pairs")
    near = packed(reach(target, pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), most_edges).select("node"), "near")
    inner = pairs.join(near.toDF("src"), "src", "left_semi").join(near.toDF("dst"), "dst", "left_semi")
    edge = F.lit(None).cast("string")
    got = _grown(inner.select("src", "dst", (F.col("edge_key") if key is None else key).alias("edge_key")), source, target, k, most_edges, most_rows)
    return got if got.status == "ok" else _grown(pairs.select("src", "dst", edge.alias("edge_key")), source, target, k, most_edges, most_rows)


def _grown(edges: DataFrame, source: DataFrame, target: DataFrame, k: int, most_edges: int, most_rows: int | None) -> PathSearch:
    """path_search over all of these edges (src, dst, edge_key)."""
    step = packed(edges, "steps")
    goal = target.select(F.col("node").alias("goal")).distinct()
    front = materialize(source.select("node", F.array("node").alias("nodes"), F.array().cast("array<string>").alias("edge_keys")).distinct(), "paths")
    levels, limited, found, grown = [], False, 0, 0
    done = None
    for level in range(most_edges + 1):
        hit = front.join(goal, front["node"] == goal["goal"], "left_semi")
        done = hit if done is None else done.unionByName(hit)
        levels.append(front.select("node").distinct().withColumn("from_source", F.lit(level)))
        found += hit.count()
        if found >= k:
            break
        go = front.join(goal, front["node"] == goal["goal"], "left_anti")
        if level == most_edges:
            limited = not go.join(step, go["node"] == step["src"], "left_semi").isEmpty()
            break
        grown += go.count()
        if most_rows is not None and grown > most_rows:
            limited = True
            break
        front = materialize(go.join(step, go["node"] == step["src"]).where(~F.array_contains("nodes", F.col("dst"))).select(F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("edge_keys", F.array("edge_key")).alias("edge_keys")), "paths")
        if front.isEmpty():
            break
    ranked = done.withColumn("n_edges", F.size("edge_keys")).orderBy("n_edges", "edge_keys").limit(k)
    paths = ranked.withColumn("rank", F.row_number().over(Window.orderBy("n_edges", "edge_keys"))).select("rank", "n_edges", "edge_keys", "nodes")
    reached = reduce(DataFrame.unionByName, levels).groupBy("node").agg(F.max("from_source").alias("from_source"))
    return PathSearch("ok" if found else "search_limit" if limited else "no_path", paths, reached)


def k_paths(edges: DataFrame, source: DataFrame, target: DataFrame, k: int = 3, most_edges: int = 64, most_rows: int | None = 50_000, relations=("calls", "imports"), key: Column | None = None) -> DataFrame:
    """rank, n_edges, edge_keys, nodes and status of the first k paths; without any, one row of the status alone."""
    got = path_search(edges, source, target, k, most_edges, most_rows, relations, key)
    one = edges.sparkSession.createDataFrame([(got.status,)], "status string")
    return one.crossJoin(got.paths) if got.status == "ok" else one.join(got.paths, F.lit(False), "left")  # one row on the left


def nearest_approach(edges: DataFrame, source: DataFrame, target: DataFrame, most_edges: int = 64, most: int = 5, most_rows: int = 50_000, relations=("calls", "imports")) -> DataFrame:
    """Where no path was found: reached nodes that come nearest to the target, by distance to it (unknown last), then the longest way from the source, then key. Empty if there is a path."""
    got = path_search(edges, source, target, 1, most_edges, most_rows, relations)
    if got.status == "ok":
        return got.reached.withColumn("to_target", F.lit(None).cast("int")).limit(0)
    step = edges.where(F.col("relation").isin(*relations)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    back = reach(target, step).withColumnRenamed("hop", "to_target")
    return got.reached.join(back, "node", "left").orderBy(F.col("to_target").asc_nulls_last(), F.desc("from_source"), "node").limit(most)


LINKAGE = "CASE origin WHEN 'compiler' THEN 'static' WHEN 'heuristic' THEN 'naming' WHEN 'git' THEN 'historical' ELSE 'evidence' END"


def find_tests(edges: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Tests at the other end of a `tests` edge of each target, with the kind of linkage."""
    link = edges.where("relation = 'tests'").withColumn("linkage", F.expr(LINKAGE))
    both = link.select(F.col("src").alias("test"), F.col("dst").alias("node"), "linkage", "confidence").union(link.select(F.col("dst"), F.col("src"), "linkage", "confidence"))
    tests = nodes.where("kind = 'test'").select(F.col("node_key").alias("test"))
    return both.join(targets.select("node"), "node").join(tests, "test").select("node", "test", "linkage", "confidence")


STORY_LABEL = """CASE WHEN resolution = 'unresolved' THEN 'unresolved' WHEN origin = 'heuristic' AND resolution = 'partial' THEN 'ambiguous'
 WHEN confidence = 'inferred' THEN 'inferred' WHEN tested THEN 'test-backed' WHEN documented THEN 'documented'
 WHEN origin = 'compiler' AND resolution = 'resolved' THEN 'statically-resolved' ELSE 'inferred' END"""


def story(edges: DataFrame, entry: DataFrame, depth: int = 8, relations=("routes_to", "calls", "references")) -> DataFrame:
    """Transitions of a walk from the entry node: every outgoing edge of a reached node, labelled; unresolved edges end the walk."""
    out = edges.where(F.col("relation").isin(*relations))
    seen = reach(entry, out.where("resolution <> 'unresolved'").select("src", "dst"), depth)
    mark = lambda relation, name: edges.where(F.col("relation") == relation).select(F.col("dst"), F.lit(True).alias(name)).distinct()
    steps = out.join(seen.select(F.col("node").alias("src"), "hop"), "src").join(mark("tests", "tested"), "dst", "left").join(mark("documents", "documented"), "dst", "left").na.fill(False, ["tested", "documented"])
    return steps.select("hop", "src", "edge_key", "relation", "dst", F.expr(STORY_LABEL).alias("label"))


def context(edges: DataFrame, nodes: DataFrame, anchor: DataFrame, depth: int = 2, relations=("calls", "imports", "tests"), signature_types: DataFrame | None = None) -> DataFrame:
    """Ranked neighbours of the anchor (node): distance both ways, fan-in, linked test, same package, best connecting confidence, and the linear score.

    Hard priority: 2 for a compiler-made, certain and resolved caller or callee or a certainly linked test,
    1 for other callers and callees, else 0; 2 for the types that the anchor's signature names (node). Callers,
    callees, certainly linked tests and signature types belong to the context whatever the relations; the
    walk goes on from them, but for types that no edge reaches. Order: priority, score, confidence, key.
    """
    columns = ["src", "dst", "relation", "origin", "confidence", "resolution"]
    use = packed(edges.where(F.col("relation").isin(*relations)).select(*columns), "use")  # without edge keys, which nothing here reads
    both = use.select(*columns).union(use.select("dst", "src", "relation", "origin", "confidence", "resolution"))
    at = anchor.select("node").distinct()
    sides = edges.where("relation = 'calls' OR (relation = 'tests' AND confidence = 'certain')").select(F.inline(F.array(F.struct("src", "dst", "relation", "origin", "confidence", "resolution"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "origin", "confidence", "resolution"))))
    forced = sides.join(at.toDF("src"), "src").join(nodes.select(F.col("node_key").alias("dst"), "kind"), "dst").where("relation = 'calls' OR kind = 'test'").where("src <> dst").select("src", "dst", "relation", "origin", "confidence", "resolution")
    forced = materialize(forced, "forced")
    seen = reach(anchor, both.select("src", "dst").union(forced.select("src", "dst")), depth)
    # the forced edges, seen from their far end, connect it to the anchor
    both = both.union(forced.where(~F.col("relation").isin(*relations)).select("dst", "src", "relation", "origin", "confidence", "resolution"))
    rank = F.expr("CASE confidence WHEN 'certain' THEN 2 WHEN 'likely' THEN 1 ELSE 0 END")
    kinds = nodes.select(F.col("node_key").alias("node"), "kind", "package")
    # connecting edges lead to a node exactly one hop nearer
    near = seen.select(F.col("node").alias("dst"), (F.col("hop") + 1).alias("hop"))
    hard = F.when((F.col("hop") == 1) & (F.col("relation") == "calls"), F.when(F.expr("origin = 'compiler' AND confidence = 'certain' AND resolution = 'resolved'"), 2).otherwise(1)).otherwise(0)
    linked = both.join(seen.withColumnRenamed("node", "src"), "src").join(near, ["dst", "hop"]).groupBy(F.col("src").alias("node"), "hop").agg(F.max(rank).alias("confidence_rank"), F.max(hard).alias("call_priority"), F.max(F.when((F.col("hop") == 1) & (F.col("relation") == "tests"), F.when(F.col("confidence") == "certain", 2).otherwise(1)).otherwise(0)).alias("test_link"))
    if signature_types is not None:
        typed = signature_types.select("node").distinct().join(at, "node", "left_anti")
        apart = typed.join(linked.select("node"), "node", "left_anti").select("node", F.lit(1).alias("hop"), F.lit(0).alias("confidence_rank"), F.lit(0).alias("call_priority"), F.lit(0).alias("test_link"))
        linked = linked.unionByName(apart).join(typed.withColumn("typed", F.lit(2)), "node", "left").withColumn("call_priority", F.greatest("call_priority", F.coalesce("typed", F.lit(0)))).drop("typed")
    own = kinds.join(anchor.select("node"), "node").select(F.col("package").alias("anchor_package"))
    fan = edges.where("relation IN ('imports', 'references', 'calls', 'implements', 'extends', 'routes_to')").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    rows = linked.join(kinds, "node").join(fan, "node", "left").crossJoin(own.limit(1))  # one anchor row
    rows = rows.withColumns({
        "fan_in": F.coalesce("fan_in", F.lit(0)),
        "priority": F.greatest("call_priority", F.when((F.col("kind") == "test") & (F.col("test_link") == 2), 2).otherwise(0)),
        "linked_test": (F.col("test_link") > 0).cast("int"),
        "same_package": F.coalesce((F.col("package") == F.col("anchor_package")).cast("int"), F.lit(0)),
    })
    score = 2.5 / (1 + F.col("hop")) + F.log1p("fan_in") + 1.5 * F.col("linked_test") + 0.5 * F.col("same_package")
    return rows.select("node", "hop", "priority", "fan_in", "confidence_rank", F.round(score, 6).alias("score"))


CONTEXT_ORDER = ("priority", "score", "confidence_rank")


def within_budget(ranked: DataFrame, order: list, cost, budget: int) -> DataFrame:
    """The longest prefix, in order, whose running cost stays within the budget. Every row costs at least 1, so no more than `budget` rows can fit or are sorted."""
    top = ranked.withColumn("cost", cost).orderBy(*order).limit(budget)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("running", F.sum("cost").over(w)).where(F.col("running") <= budget)


def budget_ladder(ranked: DataFrame, order: list, costs: dict[str, Column], budget: int) -> tuple[str, DataFrame]:
    """The richest representation (costs: richest first) in which all rows fit the budget, else the last with the longest prefix that fits; a budget that not even the first row fits is refused."""
    total = ranked.agg(*[F.sum(c).alias(n) for n, c in costs.items()]).first()
    for name, cost in costs.items():
        if (total[name] or 0) <= budget:
            return name, within_budget(ranked, order, cost, budget)
    shown = materialize(within_budget(ranked, order, cost, budget), "shown")
    if shown.isEmpty():
        raise ValueError(f"budget {budget} can't fit one candidate")
    return name, shown
