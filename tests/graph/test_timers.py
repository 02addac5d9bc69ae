import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import refresh, review
from tessera.streaming import timers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, old)


def drive(spark, tmp_path, files, schema, make):
    """Write files one after the other and run the query anew over each half of them, from its checkpoint."""
    source, sink, place = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for half in (files[: len(files) // 2], files[len(files) // 2 :]):
        for rows in half:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
        q = make(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", place).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(150)
    return spark.read.parquet(sink)


def shuffled(rows, r, late_s):
    """In order of arrival: up to late_s seconds after the event; some rows arrive twice."""
    arrive = sorted(((x[1] + dt.timedelta(seconds=r.uniform(0, late_s)), k) for x in [0] for k, x in enumerate(rows)), key=lambda p: p[0]) if rows else []
    out = [rows[k] for _, k in arrive]
    for k in range(0, len(out) - 3, 7):
        out.insert(k + 2, out[k])
    return out


def files_of(rows, n):
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_debounced_stream_is_the_batch_operator(rocks, tmp_path):
    r = random.Random(2)
    rows, n = [], 0
    for key in range(4):
        at = START
        for _ in range(60):
            at += dt.timedelta(seconds=r.choice([1, 2, 3, 20, 45, 400]))
            rows.append((n, at, key, r.choice("pqr"), r.choice(["change", "change", "rename", "rescan"])))
            n += 1
    arriving = shuffled(rows, r, 200) + [(n, START + dt.timedelta(days=2), 99, "p", "change")]
    schema = "event_id long, ts timestamp, task long, path string, kind string"
    out = drive(rocks, tmp_path, files_of(arriving, 4), schema, lambda s: timers.debounced(s, "task", 30_000_000, 60_000_000, "300 seconds"))
    got = sorted((x.task, x.generation, x.start, x.end, x.n_events) for x in out.collect())
    want = review.debounce(rocks.createDataFrame(rows, schema), "task", "30 SECONDS", "60 SECONDS").orderBy("task", "start").collect()
    per, expected = {}, []
    for x in want:
        per[x.task] = per.get(x.task, 0) + 1
        expected.append((x.task, per[x.task], x.start, x.end, x.n_events))
    assert got == expected and len(got) > 40
    for x in out.collect():
        merged = {}
        for _, at, key, path, kind in rows:
            if key == x.task and x.start <= at <= x.end:
                merged[path] = timers.stronger(merged.get(path), kind)
        assert [(c.path, c.kind) for c in x.changes] == sorted(merged.items())


def test_refresh_loop_stream_is_the_batch_operator(rocks, tmp_path):
    r = random.Random(3)
    rows, n = [], 0
    for key in range(3):
        at = START
        for _ in range(50):
            at += dt.timedelta(seconds=r.choice([0, 1, 5]))
            step = r.choice(["change", "begin", "begin", *timers.TERMINAL, "done", "odd"])
            rows.append((n, at, key, step, r.choice("pq") if step == "change" else None, "rename" if step == "change" and r.random() < 0.3 else None))
            n += 1
    arriving = shuffled(rows, r, 20) + [(n, START + dt.timedelta(days=1), 99, "change", "p", None)]
    schema = "event_id long, ts timestamp, task long, step string, path string, kind string"
    out = drive(rocks, tmp_path, files_of(arriving, 4), schema, lambda s: timers.refresh_loop(s, "task", "60 seconds"))
    want = refresh.loop_states(rocks.createDataFrame(rows, schema), "task")
    assert sorted(tuple(x) for x in out.drop("hinted").fillna("-").collect()) == sorted(tuple(x) for x in want.fillna("-").collect())
    seen = {x.outcome for x in want.collect()}
    assert seen == {None, "ignored", "failed", "obsolete", "requeued", "published", "noop"}
    assert out.where("hinted IS NOT NULL AND step <> 'begin'").count() == 0 and out.where(F.size("hinted") > 1).count() > 0


def test_timers_need_rocksdb(spark, tmp_path):
    spark.createDataFrame([(1, START, 1, "p", "change")], "event_id long, ts timestamp, task long, path string, kind string").write.parquet(str(tmp_path / "x"))
    stream = spark.readStream.schema("event_id long, ts timestamp, task long, path string, kind string").parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="RocksDB"):
        timers.debounced(stream, "task", 1, 1)
