import random
import time

from pyspark.sql import functions as F

from tessera.operators import intervals

SPANS, POINTS, HUNKS = "file string, node long, s_start long, s_end long", "file string, point long, at long", "file string, hunk long, h_start long, h_end long"


def test_against_all_pairs(spark):
    r = random.Random(1)
    span = lambda most: (lambda a: (a, a + r.choice([0, 1, 7, 8, 63, 64, 500, -1, most])))(r.randint(-20, 700))
    spans = [(r.choice("ab"), i, *span(5000)) for i in range(250)] + [(None, 900, 0, 9), ("a", 901, None, 3), ("a", 902, 3, None)]
    hunks = [(r.choice("abc"), i, *span(900)) for i in range(120)] + [("a", 900, None, None)]
    points = [(r.choice("abc"), i, r.randint(-30, 6000)) for i in range(400)] + [("a", 900, None), (None, 901, 3)]
    live = [s for s in spans if None not in s and s[2] <= s[3]]
    got = sorted((x.hunk, x.node) for x in intervals.overlaps(spark.createDataFrame(hunks, HUNKS), spark.createDataFrame(spans, SPANS)).collect())
    assert got == sorted((h, n) for f, h, a, b in hunks if a is not None and a <= b for g, n, c, d in live if f == g and c <= b and d >= a)
    want = {}
    for f, p, at in points:
        fit = [(d - c, c, n) for g, n, c, d in live if f == g and at is not None and c <= at <= d]
        if fit:
            want[f, p] = min(fit)[2]
    got = intervals.enclosing(spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS)).collect()
    assert {(x.file, x.point): x.node for x in got} == want and len(got) == len(want)


def test_empty(spark):
    assert intervals.overlaps(spark.createDataFrame([], HUNKS), spark.createDataFrame([], SPANS)).count() == 0
    assert intervals.enclosing(spark.createDataFrame([("a", 1, 1)], POINTS), spark.createDataFrame([], SPANS)).count() == 0


def test_one_file_with_many_nested_spans_is_linear(spark):
    """100,000 points in one file under 50,000 spans around each other and 50,000 small ones: all pairs would be billions."""
    n = 100_000
    deep = spark.range(n // 2).select(F.lit("f").alias("file"), F.col("id").alias("node"), F.col("id").alias("s_start"), (2 * n - F.col("id")).alias("s_end"))
    small = spark.range(n // 2).select(F.lit("f").alias("file"), (F.col("id") + n).alias("node"), (n // 2 + F.col("id") * 2).alias("s_start"), (n // 2 + F.col("id") * 2).alias("s_end"))
    points = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("point"), (F.col("id") + n // 2).alias("at"))
    began = time.time()
    got = intervals.enclosing(points, deep.union(small))
    assert got.count() == n and got.where("node >= 100000").count() == n // 2 and got.where("node < 100000").agg(F.min("node"), F.max("node")).first()[:] == (n // 2 - 1, n // 2 - 1)
    assert time.time() - began < 90


def test_span_ends_are_rounded_as_the_sql_casts(spark, tmp_path):
    """A balance of 2.5 is 2 in SQL's cast and 3.5 is 4."""
    from tessera.plans import catalog

    rows = [(1, 7, 2.5), (2, 7, 3.5), (3, 7, -0.5), (4, 7, 2.4)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    assert {x.node: x.s_end for x in catalog._spans(spark, str(tmp_path)).collect()} == {1: 43, 2: 46, 3: 43, 4: 46}
