"""Vocabulary, ranks and identities of the typed property graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import PASSES

# Vocabularies and rank orders that results depend on.
NODE_KINDS = ("package", "file", "function", "method", "class", "interface", "type", "route", "test", "adr", "doc_section", "external_dep", "unresolved")
RELATIONS = ("contains", "imports", "exports", "references", "calls", "implements", "extends", "tests", "routes_to", "documents", "changed_with")
FAN_IN_RELATIONS = ("imports", "references", "calls", "implements", "extends", "routes_to")
ORIGINS = ("llm", "heuristic", "human", "git", "doc", "compiler")  # weakest first
CONFIDENCES = ("inferred", "likely", "certain")
RESOLUTIONS = ("unresolved", "partial", "resolved")
CAPABILITIES = ("inventory", "structural", "semantic")
SEVERITIES = ("info", "warning", "error")


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in its order, null outside."""
    chain = F.when(value == order[0], F.lit(0))
    for i, v in enumerate(order[1:], 1):
        chain = chain.when(value == v, F.lit(i))
    return chain


def value_of(rank: Column, order: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in order]), rank.cast("int"))


def escape(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def identity(kind: str, *parts: Column) -> Column:
    """SHA-256 of the kind and the escaped parts joined by bars."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *[escape(p) for p in parts]), 256)


def node_key(kind: Column, qualified: Column) -> Column:
    return identity("node", kind, qualified)


def plain_key(kind: Column, qualified: Column) -> Column:
    """What node_key is the digest of: equal where keys are, and unlike them short and easily compressed. For joins whose result has no key."""
    return F.concat_ws("|", escape(kind), escape(qualified))


def key_of_plain(plain: Column) -> Column:
    return F.sha2(F.concat(F.lit("node|"), plain), 256)


def file_key(path: Column) -> Column:
    return identity("file", path)


def edge_key(src: Column, relation: Column, dst: Column) -> Column:
    return identity("edge", src, relation, dst)


def named_edge_key() -> Column:
    """The key of an edge by the kinds and qualified names of its ends."""
    return edge_key(node_key(F.col("src_kind"), F.col("src_name")), F.col("relation"), node_key(F.col("dst_kind"), F.col("dst_name")))


def with_edge_keys(named: DataFrame) -> DataFrame:
    """Edges by kind and qualified name of their ends (src_kind, src_name, relation, dst_kind, dst_name, more) with keys in the names' place."""
    more = [c for c in named.columns if c not in ("src_kind", "src_name", "relation", "dst_kind", "dst_name")]
    ends = named.select(node_key(F.col("src_kind"), F.col("src_name")).alias("src"), "relation", node_key(F.col("dst_kind"), F.col("dst_name")).alias("dst"), *more)
    return ends.select(edge_key(F.col("src"), F.col("relation"), F.col("dst")).alias("edge_key"), *ends.columns)


def plain_ends(named: DataFrame) -> DataFrame:
    """As with_edge_keys, but src and dst are the nodes' plain keys, and there is no edge key."""
    more = [c for c in named.columns if c not in ("src_kind", "src_name", "relation", "dst_kind", "dst_name")]
    return named.select(plain_key(F.col("src_kind"), F.col("src_name")).alias("src"), "relation", plain_key(F.col("dst_kind"), F.col("dst_name")).alias("dst"), *more)


def edge_key_of_plain(src: str = "src", relation: str = "relation", dst: str = "dst") -> Column:
    """The key of an edge by its ends' plain keys."""
    return edge_key(key_of_plain(F.col(src)), F.col(relation), key_of_plain(F.col(dst)))


def passing(named: DataFrame) -> DataFrame:
    """plain_ends with the edge's pass (shared.in_passes), which is made of the names: a pass skips the others' edges before it makes keys."""
    return plain_ends(named.withColumn("pass", F.pmod(F.xxhash64("src_kind", "src_name", "relation", "dst_kind", "dst_name"), F.lit(PASSES)).cast("int")))


def keys_of(edges: DataFrame) -> tuple[Column, Callable[[Column], Column]]:
    """The key of an edge, and what makes a node's key of an end: edges without edge_key have plain keys as their ends."""
    return (F.col("edge_key"), lambda end: end) if "edge_key" in edges.columns else (edge_key_of_plain(), key_of_plain)


def with_pass(df: DataFrame, *by: str) -> DataFrame:
    """df with its rows' pass, which rows that have one (passing) keep."""
    return df if "pass" in df.columns else df.withColumn("pass", F.pmod(F.xxhash64(*by), F.lit(PASSES)).cast("int"))


def body_hash(text: Column) -> Column:
    """SHA-256 of the text with runs of blanks collapsed, trimmed."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def claim_score(origin: Column, confidence: Column, resolution: Column) -> Column:
    return 100 * rank_of(confidence, CONFIDENCES) + 10 * rank_of(resolution, RESOLUTIONS) + rank_of(origin, ORIGINS)


def strongest_claims(edges: DataFrame, keys: list[str], evidence: str | None = None) -> DataFrame:
    """One row per key with the origin, confidence and resolution of the highest score; evidence lists are united."""
    scored = edges.withColumn("score", claim_score(F.col("origin"), F.col("confidence"), F.col("resolution")))
    return strongest_scores(scored, keys, evidence)


def strongest_scores(scored: DataFrame, keys: list[str], evidence: str | None = None) -> DataFrame:
    """strongest_claims of rows that have their claim_score as `score` already."""
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(evidence)))).alias(evidence)] if evidence else []
    best = scored.groupBy(*keys).agg(F.max("score").alias("_s"), F.count("*").alias("n_claims"), *more)
    s = F.col("_s")
    return best.select(*keys, value_of(s % 10, ORIGINS).alias("origin"), value_of(F.floor(s / 100), CONFIDENCES).alias("confidence"), value_of(F.floor(s % 100 / 10), RESOLUTIONS).alias("resolution"), "n_claims", *([evidence] if evidence else []))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no node of the same snapshot; must be empty before a snapshot is activated."""
    have = nodes.select("node_key")
    return edges.join(have, edges["src"] == have["node_key"], "left_anti").unionByName(
        edges.join(have, edges["src"] == have["node_key"], "left_semi").join(have, edges["dst"] == have["node_key"], "left_anti")
    )
