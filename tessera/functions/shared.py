"""Small helpers that every operator may use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a temporary one serves a local master; a cluster needs one that all its machines see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df under the shared folder and read it back: lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written in it drops its shuffle files as soon as it is written, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def packed(df: DataFrame, name: str) -> DataFrame:
    """materialize for long tables: packed more closely, and its shuffles take no disk afterwards."""
    with shuffles_freed(df.sparkSession):
        return materialize(df, name, compression="zstd")


#: Passes over tables whose rows meet by a key (in_passes): fixed, so that reading grows as the tables do.
PASSES = 8


def in_passes(make: Callable[[int], DataFrame], name: str) -> DataFrame:
    """The union of make(0) to make(PASSES - 1), each of the rows whose key's hash leaves that rest. A pass is written before the next begins, so only one pass's shuffles take disk at a time."""
    return reduce(DataFrame.unionByName, [packed(make(i), name) for i in range(PASSES)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
