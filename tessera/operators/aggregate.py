"""Counting operators over nodes and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import model
from tessera.functions.shared import materialize


def relation_histogram(edges: DataFrame) -> DataFrame:
    """Edges per relation; relations without edges count 0."""
    every = F.explode(F.array(*[F.lit(r) for r in model.RELATIONS])).alias("relation")
    names = edges.sparkSession.range(1).select(every)
    return names.join(edges.groupBy("relation").agg(F.count("*").alias("n")), "relation", "left").select("relation", F.coalesce("n", F.lit(0)).alias("n_edges"))


def package_rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per package node: files it contains directly or that declare its name, and symbols in those files."""
    packages = nodes.where("kind = 'package'").select(F.col("node_key").alias("pkg"), F.col("display_name").alias("package_name"))
    inside = edges.where("relation = 'contains'").join(packages, F.col("src") == F.col("pkg")).join(nodes.select(F.col("node_key").alias("dst"), "file"), "dst").where("file IS NOT NULL").select("pkg", "file")
    declared = nodes.where("kind = 'file'").join(packages, F.col("package") == F.col("package_name")).select("pkg", "file")
    files = inside.union(declared).distinct()
    symbols = nodes.where("kind <> 'file' AND file IS NOT NULL").groupBy("file").agg(F.count("*").alias("n"))
    totals = files.join(symbols, "file", "left").groupBy("pkg").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_symbols"))
    return packages.join(totals, "pkg", "left").select(F.col("pkg").alias("node_key"), "package_name", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def endpoints(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges with the named node columns of both ends as src_* and dst_*."""
    for side in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node_key").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return edges


def package_dependencies(nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """Import edges between different declared packages, counted; the first `most` by name."""
    both = endpoints(edges.where("relation = 'imports'"), nodes, "package").where("src_package <> dst_package")
    return both.groupBy("src_package", "dst_package").agg(F.count("*").alias("n_imports")).orderBy("src_package", "dst_package").limit(most)


def directory_counts(nodes: DataFrame) -> DataFrame:
    """Files per first path segment, `.` for files at the root."""
    top = F.when(F.instr("file", "/") > 0, F.substring_index("file", "/", 1)).otherwise(F.lit("."))
    return nodes.where("kind = 'file'").groupBy(top.alias("directory")).agg(F.count("*").alias("n_files"))


def language_stats(nodes: DataFrame, generated: Column, capability: Column) -> DataFrame:
    """Files and generated files per language, with capabilities in their fixed order."""
    have = F.collect_set(capability)
    ordered = F.array_join(F.filter(F.array(*[F.lit(c) for c in model.CAPABILITIES]), lambda c: F.array_contains(have, c)), ",")
    return nodes.where("kind = 'file' AND language IS NOT NULL").groupBy("language").agg(F.count("*").alias("n_files"), F.count_if(generated).alias("n_generated"), ordered.alias("capabilities"))


def severity_histogram(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in model.SEVERITIES])


def fan_in(edges: DataFrame) -> DataFrame:
    """Incoming edges of the six dependency relations."""
    return edges.where(F.col("relation").isin(*model.FAN_IN_RELATIONS)).groupBy(F.col("dst").alias("node_key")).agg(F.count("*").alias("fan_in"))


def hotspots(nodes: DataFrame, edges: DataFrame, most: int = 8, key: Callable[[Column], Column] = lambda k: k) -> DataFrame:
    """Highest fan-in first, then name, then key. key: what the key is in the result, where nodes and edges meet by another."""
    return nodes.join(fan_in(edges), "node_key").select(key(F.col("node_key")).alias("node_key"), "display_name", "fan_in").orderBy(F.desc("fan_in"), "display_name", "node_key").limit(most)


def provenance_buckets(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation", "origin", "confidence", "resolution").agg(F.count("*").alias("n_edges"))


def extractor_inventory(contributions: DataFrame) -> DataFrame:
    """id, version, capability, language rows -> one per (id, version): strongest capability and distinct languages."""
    strongest = model.value_of(F.max(model.rank_of(F.col("capability"), model.CAPABILITIES)), model.CAPABILITIES)
    return contributions.groupBy("id", "version").agg(strongest.alias("capability"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


def omission_fold(omissions: DataFrame, keys: list[str], keep: int = 19) -> DataFrame:
    """Sums per key; beyond keep + 1 rows all after the first `keep` by size are folded to one `other` row: the total less the first ones, so only these are ordered."""
    sums = materialize(omissions.groupBy(*keys).agg(F.sum("n").alias("n")), "sums")
    order = [F.desc("n"), *keys]
    top = sums.orderBy(*order).limit(keep + 1).withColumn("r", F.row_number().over(Window.orderBy(*order)))
    all_ = sums.agg(F.count("*").alias("rows"), F.sum("n").alias("total"))  # one row
    marked = top.crossJoin(all_)
    first = marked.where((F.col("rows") <= keep + 1) | (F.col("r") <= keep)).select(*keys, "n")
    other = marked.where((F.col("rows") > keep + 1) & (F.col("r") <= keep)).groupBy("total").agg(F.sum("n").alias("kept"))
    return first.unionByName(other.select(*[F.lit("other").alias(k) for k in keys], (F.col("total") - F.col("kept")).alias("n")))


def median(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The middle value, or the mean of the two middle ones, exactly; ranks are over (value, count) pairs as in nearest_rank."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    upto = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col(value)))
    return upto.groupBy(*by).agg(((at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor((F.col("_all") + 2) / 2))) / 2).alias("median"), F.max("_all").alias("n"))


def aggregate_provenance(edges: DataFrame, by: list[str]) -> DataFrame:
    """For each aggregate (by): its edges, the (origin, confidence, resolution) buckets as sorted `o/c/r=n` text, distinct languages, capabilities and derivations, and the evidence it leaves out (n_evidence summed)."""
    buckets = edges.groupBy(*by, "origin", "confidence", "resolution").agg(F.count("*").alias("n"))
    text = F.concat(F.concat_ws("/", "origin", "confidence", "resolution"), F.lit("="), F.col("n"))
    buckets = buckets.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias("buckets"))
    sets = [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name) for c, name in (("language", "languages"), ("capability", "capabilities"), ("derivation", "derivations"))]
    return edges.groupBy(*by).agg(F.count("*").alias("n_edges"), *sets, F.sum("n_evidence").alias("n_evidence_omitted")).join(buckets, by)


def nearest_rank(values: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """The ceil(share * n)-th smallest value, not interpolated; ranks are over (value, count) pairs, so ties shrink first."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(value)
    total = F.sum("_n").over(Window.partitionBy(*by))
    upto = counts.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", total)
    return upto.where(F.col("_upto") >= F.ceil(F.col("_all") * share)).groupBy(*by).agg(F.min(value).alias("value"), F.max("_all").alias("n"))


def suite_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """success, tokens (nullable), wall_ms -> success rate, total tokens (null if any is null) and mean time."""
    return runs.groupBy(*by).agg(
        F.count("*").alias("n_runs"), F.round(F.coalesce(F.avg(F.col("success").cast("int")), F.lit(0.0)), 6).alias("success_rate"),
        F.when(F.count_if(F.col("tokens").isNull()) > 0, F.lit(None)).otherwise(F.sum("tokens")).cast("long").alias("tokens"), F.round(F.avg("wall_ms"), 6).alias("mean_wall_ms"),
    )


def set_digest(rows: DataFrame, columns: list[str], prefix: int = 2) -> DataFrame:
    """An order-independent digest: rows are hashed, hashes are sorted inside buckets, and the buckets' digests are joined in order, so no task holds all rows. Hashes travel as bytes, whose order is that of their digits."""
    row = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]), 256)
    digits = F.transform(F.sort_array(F.collect_list("h")), lambda x: F.lower(F.hex(x)))
    buckets = rows.select(F.unhex(row).alias("h")).groupBy(F.substring(F.lower(F.hex("h")), 1, prefix).alias("b")).agg(F.sha2(F.array_join(digits, "\n"), 256).alias("d"), F.count("*").alias("n"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
