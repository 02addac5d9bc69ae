"""Target-distribution importance resampling over hashed n-grams, with the CRC combination algebra.

A feature is a run of 1 to `n` words joined by one space; its bucket is the CRC-32 of its bytes modulo
`buckets`. Each distinct word's CRC is computed once a block of text. The CRC of an n-gram follows from those of
its parts: appending bytes multiplies a CRC by a GF(2) matrix that depends on their number only, so
crc(x + " " + w) = shift(shift(crc(x), 1) ^ crc(" "), len(w)) ^ crc(w). Matrices for shifts by powers of two
bytes serve any length, and no n-gram string is made.

One pass over the raw documents and one over the target count features a bucket (tasks send at most `buckets`
rows), gains of buckets are computed, and a second pass sums them over each document. Scores add Gumbel noise
from a hash of the id, so that the highest are a sample without replacement. Places in the order follow from a
sort by ranges: a row's place in its partition, plus the rows of the partitions before it. No window spans
documents.

Defined results: null, empty and wordless texts have no features and weight 0; null ids hash as an empty id and
come last among equal scores; equal rows are each counted and may each be drawn; very long texts are one block of
their own; an empty target or table is no error. Further columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.functions.shared import materialize, partitions
from tessera.llm.bytetext import ALNUM, LOWER, blocks, find_words, small_batches

POLYNOMIAL = 0xEDB88320


def zero_byte(crc: int) -> int:
    """The linear part of a CRC step: what appending a zero byte does to a register."""
    for _ in range(8):
        crc = crc >> 1 ^ POLYNOMIAL * (crc & 1)
    return crc


class Shifts:
    """Matrices over GF(2) that carry a CRC over 2**k bytes, each kept as four tables of 256 for the bytes of a CRC."""

    def __init__(self):
        self.tables: list[np.ndarray] = []
        self.columns = [zero_byte(1 << i) for i in range(32)]  # of the next matrix

    @staticmethod
    def _times(columns: list[int], x: int) -> int:
        out = 0
        while x:
            out ^= columns[(x & -x).bit_length() - 1]
            x &= x - 1
        return out

    def _extend(self) -> None:
        each = np.arange(256)
        table = np.zeros((4, 256), np.uint32)
        for bit, column in enumerate(self.columns):
            table[bit // 8] ^= np.where(each >> bit % 8 & 1, np.uint32(column), np.uint32(0))
        self.tables.append(table)
        self.columns = [self._times(self.columns, c) for c in self.columns]

    def over(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """crc after as many further bytes as lengths says, before these are added."""
        out = crc.astype(np.uint32)
        for k in range(int(lengths.max(initial=0)).bit_length()):
            if k == len(self.tables):
                self._extend()
            t = self.tables[k]
            moved = t[0][out & 255] ^ t[1][out >> 8 & 255] ^ t[2][out >> 16 & 255] ^ t[3][out >> 24]
            out = np.where(lengths >> k & 1, moved, out)
        return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word; distinct words are computed once."""
    sizes = ends - starts
    offs = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    packed = data[np.arange(offs[-1]) - np.repeat(offs[:-1] - starts, sizes)] if len(sizes) else data[:0]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs), pa.py_buffer(packed)]).dictionary_encode()
    known = np.array([zlib.crc32(w) for w in column.dictionary.to_pylist()], np.uint32)
    return known[column.indices.to_numpy()] if len(sizes) else known


def gram_buckets(data: np.ndarray, offs: np.ndarray, n: int, buckets: int, shifts: Shifts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: the buckets of all grams in the texts, and for each text the index of its first one (one more entry at the end)."""
    data = LOWER[data]
    s, e, first = find_words(ALNUM, data, offs)
    word, size, text = word_crcs(data, s, e), e - s, np.searchsorted(first[1:], np.arange(len(s)), "right")
    gram, blank = word, np.uint32(zlib.crc32(b" "))
    yield (gram % np.uint32(buckets)).astype(np.int64), first
    for k in range(1, n):
        # a gram of k + 1 words is one of k words, a space, and the word after it
        gram = shifts.over(shifts.over(gram[:-1], np.ones(max(len(gram) - 1, 0), np.int64)) ^ blank, size[k:]) ^ word[k:]
        inside = text[k:] == text[: len(text) - k]
        yield (gram[inside] % np.uint32(buckets)).astype(np.int64), np.searchsorted(text[: len(text) - k][inside], np.arange(len(offs)))
        if not len(gram):
            return


def count_buckets(docs: DataFrame, text_col: str, n: int, buckets: int) -> DataFrame:
    """bucket, count over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shifts = np.zeros(buckets, np.int64), Shifts()
        for _, data, offs in blocks(batches, "text"):
            for found, _ in gram_buckets(data, offs, n, buckets, shifts):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": at, "count": total[at]})

    texts = docs.select(docs[f"`{text_col}`"].alias("text"))
    return texts.mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln of target share by raw share), both smoothed by one a bucket; `buckets` numbers, so the driver may hold them."""
    spark = raw.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(raw.withColumnRenamed("count", "s"), "bucket", "left").join(target.withColumnRenamed("count", "t"), "bucket", "left")
    both = materialize(both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "buckets")
    sums = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    share = ((F.col("t") + 1).cast("double") * float(sums["S"] + buckets)) / ((F.col("s") + 1).cast("double") * float(sums["T"] + buckets))
    gains = np.zeros(buckets, np.int64)
    for r in both.select("bucket", F.floor(F.lit(1000.0) * F.ln(share)).alias("g")).collect():
        gains[r["bucket"]] = r["g"]
    return gains


def weigh(docs: DataFrame, text_col: str, keep: list[str], gains: np.ndarray, n: int) -> DataFrame:
    """row (the kept columns), n_words, n_features, weight."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(gains)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[f"`{text_col}`"].alias("text"))
    schema = StructType([packed.schema["row"], *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = Shifts()
        for part, data, offs in blocks(batches, "text"):
            words = features = weight = None
            for found, first in gram_buckets(data, offs, n, len(sent.value), shifts):
                sums = np.zeros(len(found) + 1, np.int64)
                np.cumsum(sent.value[found], out=sums[1:])
                per, gain = np.diff(first).astype(np.int64), sums[first[1:]] - sums[first[:-1]]
                words, features, weight = (per, per, gain) if words is None else (words, features + per, weight + gain)
            yield pa.record_batch([part.column("row"), pa.array(words), pa.array(features), pa.array(weight)], ["row", "n_words", "n_features", "weight"])

    return packed.mapInArrow(run, schema)


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with `place`, 1, 2, 3 ... in the given total order, by a sort in ranges. Rows that are equal in the order may stand in either order."""
    n = partitions(df.sparkSession)
    ranged = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))  # a row a partition
    before = before.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return ranged.withColumn("_part", part).join(before, "_part").select(*[ranged[f"`{c}`"] for c in df.columns], (F.col("_before") + inside + 1).alias("place"))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", keep: list[str] | None = None,
    n: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """row (the kept columns, all by default), n_words, n_features, weight, score and rank: 1, 2, 3 ... for the floor(percent * N / 100) highest scores of the N documents with at least `least_words` words, else null."""
    small_batches(docs.sparkSession)
    gains = bucket_gains(count_buckets(docs, text_col, n, buckets), count_buckets(target, target_text, n, buckets), buckets)
    names = list(dict.fromkeys([*(docs.columns if keep is None else keep), id_col]))
    weighed = weigh(docs, text_col, names, gains, n)
    key = F.col("row").getField(id_col)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = materialize(weighed.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("_id", key), "scored")
    asked = F.col("n_words") >= least_words
    drawn = scored.where(asked).count() * percent // 100
    placed = numbered(scored.where(asked), F.col("score").desc(), F.col("_id").asc_nulls_last())
    ranked = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")).cast("long")).drop("place", "_id")
    return ranked.unionByName(scored.where(~asked).withColumn("rank", F.lit(None).cast("long")).drop("_id"))
