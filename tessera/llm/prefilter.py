"""A semi-join reduction of fixed size in front of a shuffle join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25


def split(df: DataFrame, members: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose keys may be among the members' (all that are, and few others), and the rows whose keys surely aren't.

    Members' hashed keys set bits of a map of 2**25 bits, at most 1024 rows of 4 KB each, so its broadcast is
    4 MB whatever the input. With very many members the map fills up and more rows may be; none is missed.
    Rows travel in a struct, so df's columns can have any names.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    maps = members.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("map"))
    packed = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
    probed = packed.join(F.broadcast(maps), "b", "left")
    byte = F.conv(F.hex(F.substring("map", (F.col("p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, CAST(p % 8 AS INT))")) != 0, F.lit(False))
    columns = [F.col("row").getField(c).alias(c) for c in df.columns]
    return probed.where(bit).select(*columns), probed.where(~bit).select(*columns)


def only_maybe(df: DataFrame, members: DataFrame, *keys: str) -> DataFrame:
    """The first part of split."""
    return split(df, members, *keys)[0]


def without(df: DataFrame, members: DataFrame, *keys: str) -> DataFrame:
    """Rows of df whose keys aren't among the members' (exact; null keys stay). Rows that surely aren't don't meet the join."""
    some, rest = split(df, members, *keys)
    return rest.unionByName(some.join(members.select(*keys), list(keys), "left_anti").select(*[some[f"`{c}`"] for c in df.columns]))
