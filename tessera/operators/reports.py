"""Reports and integrity checks composed from the other operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import model
from tessera.functions.shared import materialize
from tessera.operators import aggregate, layout
from tessera.operators.search import words_of
from tessera.operators.traverse import reach_from


def mentions(signatures: DataFrame, types: DataFrame) -> DataFrame:
    """Signatures (id, signature) that name a type (node_key, display_name, qualified_name) as a whole identifier: distinct id, node_key."""
    words = signatures.select("id", F.explode(F.array_distinct(F.regexp_extract_all("signature", F.lit(r"[A-Za-z_$][\w$.]*"), 0))).alias("name"))
    names = types.select("node_key", F.explode(F.array_distinct(F.array("display_name", "qualified_name"))).alias("name"))
    return words.join(names, "name").select("id", "node_key").distinct()


def postings(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, place, word: the search index's rows."""
    every = F.array(*[F.struct(F.lit(f).alias("field"), words_of(F.col(f)).alias("words")) for f in fields])
    rows = docs.select(key, F.explode(every).alias("x"))
    return rows.select(key, "x.field", F.posexplode("x.words").alias("place", "word"))


def index_faults(members: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Keys whose number of index rows isn't one, and index rows of no member."""
    n = indexed.groupBy(key).agg(F.count("*").alias("n"))
    both = members.select(key).distinct().withColumn("member", F.lit(True)).join(n, key, "full_outer")
    wrong = F.when(F.col("member").isNull(), "orphan").when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") > 1, "repeated")
    return both.select(key, wrong.alias("fault")).where("fault IS NOT NULL")


def analyzer_versions(members: DataFrame, by: str) -> DataFrame:
    """The analyzer version of each group if it has only one, else `mixed`."""
    return members.groupBy(by).agg(F.when(F.count_distinct("version") == 1, F.min("version")).otherwise("mixed").alias("version"))


def mismatched(a: DataFrame, b: DataFrame, column: str, expected: str) -> DataFrame:
    """How many different versions other than the expected one two tables hold together: one row."""
    return a.select(column).union(b.select(column)).where(F.col(column) != expected).distinct().agg(F.count("*").alias("n_mismatched"))


def first_rows(rows: DataFrame, order: list, n: int) -> tuple[list, bool]:
    """At most n rows and whether there are more, by asking for one more."""
    got = rows.orderBy(*order).limit(n + 1).collect()
    return got[:n], len(got) > n


def ranked_in_kind(rows: DataFrame, kind: str, order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order)))


def append_checked(log: DataFrame, path: str, keys: list[str], required: list[str]) -> None:
    """Appends a log batch in which keys are unique, required columns are set and ranks count from 1; else nothing is written."""
    bad = log.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    missing = log.where(" OR ".join(f"{c} IS NULL" for c in required))
    ranks = log.groupBy("retrieval").agg(F.max("rank").alias("top"), F.min("rank").alias("low"), F.count("*").alias("n")).where("low <> 1 OR top <> n")
    for what, df in (("repeated keys", bad), ("missing values", missing), ("ranks with gaps", ranks)):
        if not df.isEmpty():
            raise ValueError(what)
    log.write.mode("append").parquet(path)


def coalesced_rows(pairs: DataFrame, removed: DataFrame, added: DataFrame, raw: DataFrame) -> DataFrame:
    """Pairs (removed_id, added_id) as one row each: `move` where the trailing name stays, else `rename`, with the raw diff rows (index, id) they stand for, sorted."""
    name = lambda c: F.element_at(F.split(c, r"[./#:]"), -1)
    both = pairs.join(removed.select(F.col("id").alias("removed_id"), F.col("name").alias("old")), "removed_id").join(added.select(F.col("id").alias("added_id"), F.col("name").alias("new")), "added_id")
    ends = both.select("removed_id", "added_id", F.explode(F.array("removed_id", "added_id")).alias("id")).join(raw, "id").groupBy("removed_id", "added_id").agg(F.sort_array(F.collect_set("index")).alias("rows"))
    kind = F.when(name(F.col("old")) == name(F.col("new")), "move").otherwise("rename")
    return both.select("removed_id", "added_id", kind.alias("kind")).join(ends, ["removed_id", "added_id"])


def first_target(edges: DataFrame, relation: str) -> DataFrame:
    """Sources of a relation with the target and origin of their first edge by key."""
    return edges.where(F.col("relation") == relation).groupBy("src").agg(F.min(F.struct("edge_key", "dst", "origin")).alias("e")).select("src", "e.dst", "e.origin")


def first_named_target(named: DataFrame, relation: str) -> DataFrame:
    """first_target of edges by the names of their ends: names are dealt out, and keys made where they have come."""
    end = lambda side: model.plain_key(F.col(f"{side}_kind"), F.col(f"{side}_name")).alias(side)
    rows = named.where(F.col("relation") == relation).select(end("src"), end("dst"), "origin").repartition("src")
    key = model.edge_key(model.key_of_plain(F.col("src")), F.lit(relation), model.key_of_plain(F.col("dst")))
    best = rows.groupBy("src").agg(F.min(F.struct(key.alias("edge_key"), "dst", "origin")).alias("e"))
    return best.select(model.key_of_plain(F.col("src")).alias("src"), model.key_of_plain(F.col("e.dst")).alias("dst"), "e.origin")


def documents_of(edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Documents with what they document, of the targets (node) only if given."""
    rows = edges.where("relation = 'documents'").select(F.col("src").alias("doc"), F.col("dst").alias("node"), "confidence")
    return rows.join(targets.select("node"), "node", "left_semi").select("doc", "node", "confidence") if targets is not None else rows


def package_family(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every package with its descendants by package-to-package `contains`, itself included: root, node, hop."""
    packages = nodes.where("kind = 'package'").select(F.col("node_key").alias("node"))
    own = packages.select("node")
    inner = edges.where("relation = 'contains'").join(own.toDF("src"), "src", "left_semi").join(own.toDF("dst"), "dst", "left_semi")
    return reach_from(packages, inner.select("src", "dst"))


def nearest_in_direction(points: DataFrame, at: str, dx: int, dy: int) -> DataFrame:
    """Of points (node, x, y) the nearest to `at` that lies more along the direction than across it."""
    origin = points.where(F.col("node") == at).select(F.col("x").alias("ox"), F.col("y").alias("oy")).limit(1)
    along = (F.col("x") - F.col("ox")) * dx + (F.col("y") - F.col("oy")) * dy
    across = F.abs((F.col("x") - F.col("ox")) * dy) + F.abs((F.col("y") - F.col("oy")) * dx)
    return points.where(F.col("node") != at).crossJoin(origin).where((along > 0) & (along >= across)).orderBy(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")), "node").limit(1).select("node")  # origin is one row


def relax(seeds: DataFrame, links: DataFrame, by: str, rounds: int = 200, most: int = 2000) -> DataFrame:
    """Spring layout of each group (a level of a package): seeds (by, node, x, y), links (by, a, b). Groups over `most` nodes keep their seeds; a task holds one smaller group. Nodes that are true in a column `pinned` push and pull but stay where they are."""
    seeds = seeds.select(by, "node", "x", "y", (F.coalesce("pinned", F.lit(False)) if "pinned" in seeds.columns else F.lit(False)).alias("pinned"))
    sizes = seeds.groupBy(by).agg(F.count("*").alias("n"))
    small = seeds.join(sizes.where(F.col("n") <= most).select(by), by)
    kind = dict(seeds.dtypes)
    schema = f"{by} {kind[by]}, node {kind['node']}, x double, y double"

    def run(key: tuple, points: pd.DataFrame, ties: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("node").reset_index(drop=True)
        place = points[["x", "y"]].to_numpy(float)
        free = ~points["pinned"].to_numpy(bool)
        at = {n: i for i, n in enumerate(points["node"])}
        pairs = np.array([(at[a], at[b]) for a, b in zip(ties["a"], ties["b"], strict=True) if a in at and b in at], int).reshape(-1, 2)
        for turn in range(rounds):
            gap = place[:, None] - place[None]
            far = np.maximum((gap**2).sum(-1), 1e-6)
            push = (gap / far[..., None]).sum(1)
            pull = np.zeros_like(place)
            if len(pairs):
                d = place[pairs[:, 1]] - place[pairs[:, 0]]
                np.add.at(pull, pairs[:, 0], d)
                np.add.at(pull, pairs[:, 1], -d)
            step = push + 0.1 * pull
            size = np.maximum(np.hypot(step[:, 0], step[:, 1]), 1e-9)
            place = place + free[:, None] * step / size[:, None] * np.minimum(size, 1 - turn / rounds)[:, None]
        return points[[by, "node"]].assign(x=place[:, 0], y=place[:, 1])

    moved = small.groupBy(by).cogroup(links.select(by, "a", "b").join(sizes.where(F.col("n") <= most).select(by), by).groupBy(by)).applyInPandas(lambda k, p, t: run(k, p, t) if len(p) else p[[by, "node", "x", "y"]], schema)
    return moved.unionByName(seeds.join(sizes.where(F.col("n") > most).select(by), by).select(by, "node", "x", "y"))


def relax_groups(seeds: DataFrame, links: DataFrame, by: str, rounds: int = 200, most: int = 2000) -> DataFrame:
    """As relax, and groups over `most` nodes move too: by the same forces, of which far nodes act through cells, as joins (layout.relax_large)."""
    seeds, links = materialize(seeds, "seeds"), materialize(links.select(by, "a", "b"), "ties")  # both are read for each kind of group
    big = seeds.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > most).select(by)
    if big.isEmpty():
        return relax(seeds, links, by, rounds, most)
    big = materialize(big, "big")
    rest = relax(seeds.join(big, by, "left_anti"), links, by, rounds, most)
    return rest.unionByName(layout.relax_large(seeds.join(big, by, "left_semi"), links.join(big, by, "left_semi"), by, rounds))


def append_seeds(placed: DataFrame, added: DataFrame, by: str) -> DataFrame:
    """Start (x, y) of added nodes (by, node) near the mean (cx, cy) of their group's placed nodes (by, node, x, y), of all placed nodes where the group has none, of the origin where nothing is placed; a hash of the node moves it by up to a half."""
    mean = lambda df: df.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    own = mean(placed.groupBy(by)).toDF(by, "gx", "gy")
    near = added.select(by, "node").join(own, by, "left").crossJoin(mean(placed))  # one row
    near = near.select(by, "node", F.round(F.coalesce("gx", "mx", F.lit(0.0)), 6).alias("cx"), F.round(F.coalesce("gy", "my", F.lit(0.0)), 6).alias("cy"))
    part = lambda at: F.conv(F.substring(F.sha2(F.col("node").cast("string"), 256), at, 8), 16, 10).cast("double") / float(1 << 32) - 0.5
    return near.select("*", F.round(F.col("cx") + part(1), 6).alias("x"), F.round(F.col("cy") + part(9), 6).alias("y"))


def append_layout(placed: DataFrame, added: DataFrame, links: DataFrame, by: str, radius: float = 25.0, rounds: int = 50, most: int = 2000) -> DataFrame:
    """by, node, x, y of added nodes: they relax among the placed ones, which don't move, and end at most `radius` from their centre. Links are those inside a group; groups over `most` nodes are relaxed by joins."""
    seeds = append_seeds(placed, added, by)
    every = placed.select(by, "node", "x", "y", F.lit(True).alias("pinned")).unionByName(seeds.select(by, "node", "x", "y", F.lit(False).alias("pinned")))
    end = relax_groups(every, links, by, rounds, most).withColumnsRenamed({"x": "ex", "y": "ey"})
    far = F.hypot(F.col("ex") - F.col("cx"), F.col("ey") - F.col("cy"))
    share = F.when(far > radius, radius / far).otherwise(1.0)
    return seeds.select(by, "node", "cx", "cy").join(end, [by, "node"]).select(by, "node", (F.col("cx") + (F.col("ex") - F.col("cx")) * share).alias("x"), (F.col("cy") + (F.col("ey") - F.col("cy")) * share).alias("y"))


def overview(nodes: DataFrame, edges: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """claim, value (text) rows of a repository: sizes, relations, languages and severities."""
    count = lambda df, what: df.agg(F.lit(what).alias("claim"), F.count("*").cast("string").alias("value"))
    pairs = lambda df, prefix, key, n: df.select(F.concat(F.lit(prefix), F.col(key)).alias("claim"), F.col(n).cast("string").alias("value"))
    out = count(nodes, "nodes").union(count(edges, "edges")).union(count(nodes.where("kind = 'package'"), "packages"))
    out = out.union(pairs(aggregate.relation_histogram(edges), "relation ", "relation", "n_edges"))
    out = out.union(pairs(nodes.where("kind = 'file' AND language IS NOT NULL").groupBy("language").agg(F.count("*").alias("n")), "language ", "language", "n"))
    return out.union(pairs(diagnostics.groupBy("severity").agg(F.count("*").alias("n")), "severity ", "severity", "n"))


# Questions in their order, each with the count it depends on.
QUESTIONS = (("unresolved", "Which unresolved references matter?"), ("ambiguous", "Who owns the ambiguous nodes?"), ("untested", "Which used nodes have no test?"), ("isolated", "Which files does nothing depend on?"))


def questions(nodes: DataFrame, edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Question rows whose count isn't zero: position, question, count."""
    used = edges.where(F.col("relation").isin(*model.FAN_IN_RELATIONS)).select(F.col("dst").alias("node_key")).distinct()
    tested = edges.where("relation = 'tests'").select(F.col("dst").alias("node_key")).distinct()
    counts = {
        "unresolved": edges.where("resolution = 'unresolved'"), "ambiguous": owners.where("status = 'ambiguous'"),
        "untested": used.join(tested, "node_key", "left_anti"), "isolated": nodes.where("kind = 'file'").join(used, "node_key", "left_anti"),
    }
    out = None
    for i, (name, text) in enumerate(QUESTIONS):
        row = counts[name].agg(F.lit(i + 1).alias("position"), F.lit(text).alias("question"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out.where("n > 0")


def badges(marks: DataFrame, positions: DataFrame) -> DataFrame:
    """marks (node_key, badge) with their position, or unplaced."""
    return marks.join(positions.select("node_key", "x", "y"), "node_key", "left").select("node_key", "badge", "x", "y", F.col("x").isNotNull().alias("placed"))


def capability_report(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """language, capability of extractors against what files show: per language both sides and whether the declaration is met."""
    rank = lambda c: F.max(model.rank_of(F.col(c), model.CAPABILITIES))
    d = declared.groupBy("language").agg(rank("capability").alias("d"))
    o = observed.groupBy("language").agg(rank("capability").alias("o"), F.count("*").alias("n_rows"))
    both = d.join(o, "language", "full_outer")
    name = lambda c: F.coalesce(model.value_of(F.col(c), model.CAPABILITIES), F.lit("none"))
    return both.select("language", name("d").alias("declared"), name("o").alias("observed"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce(F.col("o") >= F.col("d"), F.lit(False)).alias("met"))


def representative_hits(hits: DataFrame, owners: DataFrame, visible: Column) -> DataFrame:
    """Hits (node_key) with their owner as representative where it is visible, else themselves."""
    rows = hits.join(owners.select("node_key", "owner"), "node_key", "left")
    return rows.withColumn("representative", F.when(F.col("owner").isNotNull() & visible, F.col("owner")).otherwise(F.col("node_key"))).drop("owner")
