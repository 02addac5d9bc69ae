"""Ranked text search: prefix terms, phrases, bm25 over the whole table and an exact-match boost."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def _accented() -> tuple[str, str]:
    """Lower-case letters whose full decomposition is a Latin letter and marks, and these letters: Vietnamese, Polish and others with one or more marks. Letters with a stroke (ł, đ) decompose to nothing and stay."""
    found = {}
    for c in map(chr, range(0x80, 0x10000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and "a" <= base <= "z" and all(unicodedata.combining(m) for m in marks):
            found[c] = base
    return "".join(found), "".join(found.values())


ACCENTS, PLAIN = _accented()
#: Marks that follow their letter as characters of their own.
MARKS = "[\u0300-\u036f]"


def compile_query(query: str) -> list[list[str]]:
    """Tokens of letters, digits, `_` and `$`; each is a phrase of the index's words whose last is a prefix. All must match; none gives no result."""
    joined = re.findall(r"(?:\w|\$)+", re.sub(MARKS, "", query.lower()).translate(str.maketrans(ACCENTS, PLAIN)))
    return [p for p in ([w for w in re.split(r"[_$]+", t) if w] for t in joined) if p]


def fold(text: Column) -> Column:
    """Lower-case without accents."""
    return F.translate(F.regexp_replace(F.lower(text), MARKS, ""), ACCENTS, PLAIN)


def words_of(text: Column) -> Column:
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def phrase_hits(words: Column, phrase: list[str]) -> Column:
    """How often the phrase, its last word as a prefix, stands in the words."""
    n = len(phrase)
    places = F.sequence(F.lit(0), F.size(words) - n)
    match = lambda i: [(F.get(words, i + k) == p) if k < n - 1 else F.startswith(F.get(words, i + k), F.lit(p)) for k, p in enumerate(phrase)]

    def every(i: Column) -> Column:
        out = match(i)
        both = out[0]
        for c in out[1:]:
            both = both & c
        return both

    return F.when(F.size(words) >= n, F.size(F.filter(places, every))).otherwise(0)


def bm25(index: DataFrame, phrases: list[list[str]], key: str, words: str = "words") -> DataFrame:
    """key and score (greater is better) of the rows that hold all phrases. Corpus statistics span every row of the index; a phrase in over half of them counts 1e-6."""
    index = index.select(key, F.explode(F.array(words)).alias(words))  # words once a row: a generator isn't merged with what follows
    hits = index.select(key, F.size(words).alias("len"), *[phrase_hits(F.col(words), p).alias(f"f{i}") for i, p in enumerate(phrases)])
    total = index.sparkSession.range(1).crossJoin(hits.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])).drop("id")  # one row
    rows = hits.where(" AND ".join(f"f{i} > 0" for i in range(len(phrases)))).crossJoin(total)
    score = F.lit(0.0)
    for i in range(len(phrases)):
        f, n = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.greatest(F.log((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return rows.select(key, F.round(score, 6).alias("score"))


def search(index: DataFrame, query: str, key: str, fields: list[str], limit: int = 10, offset: int = 0) -> DataFrame:
    """Exact matches (any field equal to the query, cases apart) first, then bm25, then key: key, exact, score, with the number of all hits."""
    phrases = compile_query(query)
    if not phrases:
        return index.select(key, F.lit(False).alias("exact"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_hits")).limit(0)
    text = F.concat_ws("\n", *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    same = F.lit(False)
    for f in fields:
        same = same | F.coalesce(F.lower(F.trim(F.col(f))) == query.strip().lower(), F.lit(False))
    worded = index.withColumn("words", words_of(text))
    found = bm25(worded, phrases, key).join(worded.select(key, same.alias("exact")), key)
    count = found.agg(F.count("*").alias("n_hits"))
    return found.orderBy(F.desc("exact"), F.desc("score"), key).offset(offset).limit(limit).crossJoin(count).select(key, "exact", "score", "n_hits")


class PostingIndex:
    """Postings (key, field, place, word) sorted by word, and each key's length, under a path: a query reads the row groups of its words only."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.key, self.postings, self.lengths = key, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")

    @staticmethod
    def build(docs: DataFrame, key: str, fields: list[str], path: str) -> PostingIndex:
        every = F.array(*[F.struct(F.lit(f).alias("field"), words_of(F.col(f)).alias("words")) for f in fields])
        rows = docs.select(key, F.explode(every).alias("e")).select(key, "e.field", F.posexplode("e.words").alias("place", "word"))
        rows.repartitionByRange("word", key).sortWithinPartitions("word", key).write.parquet(f"{path}/postings")
        docs.select(key, F.aggregate(every, F.lit(0), lambda a, x: a + F.size(x["words"])).alias("len")).write.parquet(f"{path}/lengths")
        return PostingIndex(docs.sparkSession, path, key)

    def faults(self, members: DataFrame) -> DataFrame:
        """Members without a length row, and rows of no member: what a repair must write again."""
        both = members.select(self.key, F.lit(True).alias("m")).join(self.lengths.select(self.key, F.lit(True).alias("i")), self.key, "full_outer")
        return both.where("m IS NULL OR i IS NULL").select(self.key, F.when(F.col("m").isNull(), "orphan").otherwise("missing").alias("fault"))

    def frequency(self, phrase: list[str]) -> DataFrame:
        """key, f: how often the phrase, its last word as a prefix, stands in a field."""
        at = None
        for k, w in enumerate(phrase):
            test = F.col("word") == w if k < len(phrase) - 1 else F.startswith("word", F.lit(w))
            own = self.postings.where(test).select(self.key, "field", (F.col("place") - k).alias("place"))
            at = own if at is None else at.join(own, [self.key, "field", "place"])
        return at.groupBy(self.key).agg(F.count("*").alias("f"))

    def bm25(self, phrases: list[list[str]]) -> DataFrame:
        """key and score, as bm25 over the words."""
        total = self.lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))  # one row
        rows, score = self.lengths, F.lit(0.0)
        for i, p in enumerate(phrases):
            f = self.frequency(p).withColumnRenamed("f", f"f{i}")
            rows = rows.join(f, self.key)
            total = total.crossJoin(f.agg(F.count("*").alias(f"n{i}")))  # one row each
        for i in range(len(phrases)):
            n, f = F.col(f"n{i}"), F.col(f"f{i}")
            score = score + F.greatest(F.log((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(1e-6)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))
        return rows.crossJoin(total).select(self.key, F.round(score, 6).alias("score"))

    def search(self, members: DataFrame, query: str, fields: list[str], kind: Column | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
        """As search, of the members that `kind` lets pass; the statistics stay those of the whole index."""
        phrases = compile_query(query)
        if not phrases:
            return members.select(self.key, F.lit(False).alias("exact"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_hits")).limit(0)
        same = F.lit(False)
        for f in fields:
            same = same | F.coalesce(F.lower(F.trim(F.col(f))) == query.strip().lower(), F.lit(False))
        own = members if kind is None else members.where(kind)
        found = self.bm25(phrases).join(own.select(self.key, same.alias("exact")), self.key)
        count = found.agg(F.count("*").alias("n_hits"))  # one row
        return found.orderBy(F.desc("exact"), F.desc("score"), self.key).offset(offset).limit(limit).crossJoin(count).select(self.key, "exact", "score", "n_hits")
