"""Calls that no declaration answers for by itself: candidates by name and number of arguments, and nodes for computed calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import model


def calls_by_arity(calls: DataFrame, declared: DataFrame) -> DataFrame:
    """calls (call, caller, name, n_args) with target, n_candidates, origin, confidence and resolution.

    declared: symbol, kind, name, min_args, max_args (null: no upper bound); a row an overload, null min_args where
    the signature isn't known, which takes any call. A function or method is a candidate if one of its overloads
    takes so many arguments. The only candidate is a likely, partial target; with none or several there is no
    edge, and the count says which. Null names have no candidate. Candidates are counted once for each name and
    number of arguments that is called, not for each call.
    """
    asked = calls.select("name", "n_args").distinct()
    able = declared.where("kind IN ('function', 'method')").select("symbol", "name", "min_args", "max_args")
    takes = F.col("min_args").isNull() | ((F.col("n_args") >= F.col("min_args")) & (F.col("max_args").isNull() | (F.col("n_args") <= F.col("max_args"))))
    found = asked.join(able, "name").where(takes).groupBy("name", "n_args").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("only"))
    rows = calls.join(found, ["name", "n_args"], "left")
    one = F.col("n") == 1
    mark = lambda v: F.when(one, F.lit(v))
    return rows.select("call", "caller", "name", "n_args", F.when(one, F.col("only")).alias("target"), F.coalesce("n", F.lit(0)).alias("n_candidates"), mark("heuristic").alias("origin"), mark("likely").alias("confidence"), F.when(one, "partial").otherwise("unresolved").alias("resolution"))


def unresolved_nodes(computed: DataFrame) -> DataFrame:
    """One node for each label that a file's computed calls (file, caller, label, line) have: node_key, kind, qualified_name, display_name, file, first line."""
    qualified = F.concat("file", F.lit("::<unresolved "), "label", F.lit(">"))
    rows = computed.groupBy("file", "label").agg(F.min("line").alias("line"))
    return rows.select(model.node_key(F.lit("unresolved"), qualified).alias("node_key"), F.lit("unresolved").alias("kind"), qualified.alias("qualified_name"), F.col("label").alias("display_name"), "file", "line")


def unresolved_edges(computed: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, relation, dst, origin, confidence, resolution, n_sites, line: the file contains its unresolved nodes, and each caller calls them without a resolution. nodes: as unresolved_nodes gives them; files are named by file_key."""
    at = computed.join(nodes.select("file", F.col("display_name").alias("label"), F.col("node_key").alias("dst")), ["file", "label"])
    calls = at.groupBy(F.col("caller").alias("src"), "dst").agg(F.count("*").alias("n_sites"), F.min("line").alias("line"))
    edge = lambda df, relation, *claim: df.select("src", F.lit(relation).alias("relation"), "dst", *[F.lit(v).alias(c) for c, v in zip(("origin", "confidence", "resolution"), claim, strict=True)], "n_sites", "line")
    holds = nodes.select(model.file_key(F.col("file")).alias("src"), F.col("node_key").alias("dst"), F.lit(1).cast("long").alias("n_sites"), "line")
    return edge(holds, "contains", "compiler", "certain", "resolved").unionByName(edge(calls, "calls", "heuristic", "inferred", "unresolved"))
