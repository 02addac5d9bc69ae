import pytest
from pyspark.sql import functions as F

from tessera.operators import extract, search, segments


def test_repair_equals_a_new_build(spark, tmp_path):
    words = ["red wine", "Red", "white wine", "dry red wine", None, "wi red win", ""]
    good = spark.createDataFrame([(i, words[i % 7], f"{i} wine") for i in range(40)], "id long, name string, note string")
    bad = good.where("id % 5 <> 0").withColumn("name", F.when(F.col("id") % 7 == 2, "red red").otherwise(F.col("name")))
    bad = bad.union(bad.where("id = 3")).union(spark.createDataFrame([(99, "red wine", "x")], good.schema))
    index = segments.SegmentedIndex.create(bad, "id", ["name", "note"], str(tmp_path / "s"))
    found = {(r.id, r.fault) for r in index.repair(good).collect()}
    assert found == {(i, "missing") for i in range(0, 40, 5)} | {(i, "changed") for i in range(2, 40, 7) if i % 5} | {(3, "repeated"), (99, "orphan")}
    new = search.PostingIndex.build(good, "id", ["name", "note"], str(tmp_path / "n"))
    rows = lambda x: [tuple(r) for r in x.search(good, "red wi", ["name"], limit=50).collect()]
    assert rows(index) == rows(new) and len(index.live) == 2 and rows(new)
    assert index.repair(good).count() == 0 and len(index.segments()) == 2
    again = segments.SegmentedIndex(spark, str(tmp_path / "s"), "id", ["name", "note"])
    assert again.merge() == 3 and again.segments() == [3] and rows(again) == rows(new)
    assert again.repair(good.where("id <> 1")).collect() == [(1, "orphan")] and 1 not in {r[0] for r in rows(again)}
    index.refresh()
    assert index.live == [3, 4]


class Words:
    def read(self, path, text):
        for w in (text or "").split():
            yield {"path": path, "word": w}

    def end(self):
        return ()


class Wrong(Words):
    def read(self, path, text):
        yield {"path": path}


def test_plugin_is_a_table_function(spark):
    files = spark.createDataFrame([("a", "x y", 1), ("b", None, 2), ("a", "z", 3)], "path string, text string, `a.b` int")
    files.createOrReplaceTempView("some_files")
    extract.register_plugin(spark, "file_words", "path string, word string", Words)
    got = spark.sql("SELECT * FROM file_words(TABLE(some_files) PARTITION BY path)").collect()
    assert sorted(map(tuple, got)) == [("a", "x"), ("a", "y"), ("a", "z")]
    extract.register_plugin(spark, "wrong_words", "path string, word string", Wrong)
    with pytest.raises(Exception, match="declared are"):
        spark.sql("SELECT * FROM wrong_words(TABLE(some_files) PARTITION BY path)").collect()
    with pytest.raises(Exception, match="path and text"):
        spark.sql("SELECT * FROM file_words(TABLE(SELECT 1 AS x))").collect()
