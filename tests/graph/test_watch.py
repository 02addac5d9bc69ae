import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import watch
from tessera.streaming import timers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, old)


def put(path, text, at):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    os.utime(path, (at, at))


def test_changes_from_listing_to_listing(spark, tmp_path):
    root, state, sink, place = (str(tmp_path / x) for x in ("r", "s", "o", "c"))

    def trigger():
        q = watch.folder_changes(spark, root, state).writeStream.format("parquet").option("path", sink).option("checkpointLocation", place).trigger(availableNow=True).start()
        assert q.awaitTermination(100)
        return sorted((r.path, r.kind) for r in spark.read.schema(watch.SCHEMA).parquet(sink).collect()) if os.path.exists(sink) else []

    put(f"{root}/a.ts", "1", 1000), put(f"{root}/d/b.ts", "1", 1000), put(f"{root}/.git/x", "1", 1000), put(f"{root}/d/g.SQLite", "1", 1000)
    one = trigger()
    assert one == [("a.ts", "rename"), ("d/b.ts", "rename")]
    put(f"{root}/a.ts", "22", 2000), put(f"{root}/é c.ts", "1", 2000), os.remove(f"{root}/d/b.ts")
    two = trigger()
    assert sorted(two) == sorted([*one, ("a.ts", "change"), ("d/b.ts", "rename"), ("é c.ts", "rename")])
    assert trigger() == two


def test_changes_feed_the_debouncer(rocks, tmp_path):
    root, state, sink, place = (str(tmp_path / x) for x in ("r", "s", "o", "c"))
    for k in range(4):
        put(f"{root}/f{k}.ts", "1", 1000 + k)
        put(f"{root}/all.ts", "x" * k, 1000 + k)
        stream = watch.folder_changes(rocks, root, state).withColumn("root", F.lit("r")).withColumn("ts", F.col("seen")).withColumn("event_id", F.xxhash64("path", "seen"))
        q = timers.debounced(stream, "root", 1_000, 5_000, "0 seconds").writeStream.format("parquet").option("path", sink).option("checkpointLocation", place).trigger(availableNow=True).start()
        assert q.awaitTermination(100)
        time.sleep(0.05)
    rows = rocks.read.parquet(sink).orderBy("generation").collect()
    assert [c.path for c in rows[0].changes] == ["all.ts", "f0.ts"] and [(c.path, c.kind) for c in rows[1].changes] == [("all.ts", "change"), ("f1.ts", "rename")]
