"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes the documents its predecessor kept and returns documents; the last adds `shard`.
Stages are written as Parquet under the shared folder and read again, so each is judged on its own input
and a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.shared import materialize
from tessera.llm import contamination, mixing, neardup, prefilter, quality, sharding


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade rejects go: null, empty and short texts do; repeated rows are judged each; very long texts as a whole."""
    return quality.select_kept(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id; five-word shingles, similarity 0.8. Documents with null ids stay unless an equal set has an id; rows with the kept id stay once."""
    found = materialize(neardup.near_duplicates(docs, width=5), "found")
    gone = found.where("NOT kept AND component_id IS NOT NULL").select(F.col("id").alias("doc_id")).distinct()
    left = prefilter.without(docs, gone, "doc_id")
    # only rows that share id and text with another are numbered, in an order that follows from their values
    same = F.struct(left["doc_id"].alias("i"), F.xxhash64(left["text"]).alias("t"))
    twice = left.where("doc_id IS NOT NULL").select("doc_id", same.alias("same")).groupBy("doc_id", "same").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    twice = materialize(twice, "twice")
    some, others = prefilter.split(left, twice, "doc_id")
    packed = some.select(F.struct(*[some[f"`{c}`"] for c in some.columns]).alias("row"), F.struct(some["doc_id"].alias("i"), F.xxhash64(some["text"]).alias("t")).alias("same"))
    packed = packed.withColumn("k", F.row_number().over(Window.partitionBy("same").orderBy(F.to_json("row"))))
    first = packed.where("k = 1 OR row.doc_id IS NULL").select(*[F.col("row").getField(c).alias(c) for c in some.columns])
    return others.unionByName(first)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; rows without any, null and empty texts stay as they are, an empty benchmark changes nothing."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; null and empty texts have size 0 and copies all the same, null sources are one source, repeated rows are taken each."""
    taken = mixing.mix(docs, payload=True)
    return taken.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard, 0 to 7; copies of a text share one unless their group is larger than half a shard or the last to make way for exact counts. Null texts are in no group."""
    return sharding.with_shards(docs, 8)


STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Suffix, signature and label iterations have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
