"""A text index in immutable segments, with marks for what later segments replace.

A segment holds postings and lengths of some rows, sorted by word, and marks: keys whose rows in earlier segments no
longer count. A repair compares members with the index and writes one segment for the keys that are missing, of
other text, repeated or gone; a search over all segments then equals one over a new build. Merging writes what is
live into one segment. A segment counts once its commit file, which only one writer can create, is there; readers
see a segment whole or not at all.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shared import materialize
from tessera.operators.search import PostingIndex, words_of


class SegmentedIndex(PostingIndex):
    """PostingIndex over the live rows of all committed segments."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: list[str]):
        self.spark, self.path, self.key, self.fields = spark, path.rstrip("/"), key, fields
        self.refresh()

    @classmethod
    def create(cls, docs: DataFrame, key: str, fields: list[str], path: str) -> SegmentedIndex:
        index = cls(docs.sparkSession, path, key, fields)
        index._add(docs, docs.select(key).limit(0))
        return index

    # commits: a file a segment, {"segment": n, "replaces": [...]}

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[dict]:
        at, fs = self._fs(f"{self.path}/commits")
        return [json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/commits").collect()] if fs.exists(at) else []  # a row a segment

    def segments(self) -> list[int]:
        commits = self._commits()
        gone = {s for c in commits for s in c["replaces"]}
        return sorted(c["segment"] for c in commits if c["segment"] not in gone)

    def refresh(self) -> None:
        """Sees what has been committed since."""
        self.live = self.segments()
        if not self.live:
            return
        read = lambda table: self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/segment={s}" for s in self.live])
        postings, lengths, marks = read("postings"), read("lengths"), read("marks")
        if len(self.live) > 1:
            latest = marks.groupBy(self.key).agg(F.max("segment").alias("_upto"))
            drop = lambda df: df.join(latest, (df[self.key] == latest[self.key]) & (df["segment"] < latest["_upto"]), "left_anti")
            postings, lengths = drop(postings), drop(lengths)
        self.postings, self.lengths = postings.drop("segment"), lengths.drop("segment")

    def _digest(self) -> Column:
        return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(f).cast("string"), F.lit("\u0002")) for f in self.fields]), 256)

    def _add(self, docs: DataFrame, gone: DataFrame) -> int:
        segment = max((c["segment"] for c in self._commits()), default=0) + 1
        every = F.array(*[F.struct(F.lit(f).alias("field"), words_of(F.col(f)).alias("words")) for f in self.fields])
        rows = docs.select(self.key, F.explode(every).alias("e")).select(self.key, "e.field", F.posexplode("e.words").alias("place", "word"))
        put = lambda df, table: df.write.mode("overwrite").parquet(f"{self.path}/{table}/segment={segment}")  # noqa: E731  what an earlier try left behind was never committed
        put(rows.repartitionByRange("word", self.key).sortWithinPartitions("word", self.key), "postings")
        put(docs.select(self.key, F.aggregate(every, F.lit(0), lambda a, x: a + F.size(x["words"])).alias("len"), self._digest().alias("digest")), "lengths")
        put(gone.select(self.key).distinct(), "marks")
        return self._commit(segment, [])

    def _commit(self, segment: int, replaces: list[int]) -> int:
        at, fs = self._fs(f"{self.path}/commits/{segment:09d}.json")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps({"segment": segment, "replaces": replaces}).encode()))
        out.close()
        self.refresh()
        return segment

    def faults(self, members: DataFrame) -> DataFrame:
        """key, fault of members (the key and the fields): missing, changed (other text), repeated (more than one row in the index), and orphan for keys that are no members."""
        own = members.select(self.key, self._digest().alias("want"))
        have = self.lengths.groupBy(self.key).agg(F.count("*").alias("n"), F.min("digest").alias("digest"))
        both = own.join(have, self.key, "full_outer")
        fault = F.when(F.col("want").isNull(), "orphan").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("want") != F.col("digest"), "changed")
        return both.select(self.key, fault.alias("fault")).where("fault IS NOT NULL")

    def repair(self, members: DataFrame) -> DataFrame:
        """Writes a segment for the faulty keys alone and returns them; without faults nothing is written."""
        found = materialize(self.faults(members), "faults")
        if not found.isEmpty():
            again = members.join(found.where("fault <> 'orphan'").select(self.key), self.key, "left_semi")
            self._add(again, found.where("fault <> 'missing'"))
        return found

    def merge(self) -> int:
        """One segment of all live rows, in order of word; those before it count no longer. Texts aren't needed."""
        old, postings, lengths = self.live, self.postings, self.lengths
        segment = max(c["segment"] for c in self._commits()) + 1
        put = lambda df, table: df.write.mode("overwrite").parquet(f"{self.path}/{table}/segment={segment}")
        put(postings.repartitionByRange("word", self.key).sortWithinPartitions("word", self.key), "postings")
        put(lengths, "lengths")
        put(lengths.select(self.key).limit(0), "marks")
        return self._commit(segment, old)
