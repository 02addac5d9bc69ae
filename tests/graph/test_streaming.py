from tessera.streaming import feeds

EVENT = "event_id long, ts timestamp, task long"


def write(spark, path, rows, n):
    df = spark.createDataFrame(rows, "event_id long, t string, task long").selectExpr("event_id", "CAST(t AS TIMESTAMP) AS ts", "task")
    df.coalesce(1).write.mode("append").parquet(path)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(tuple(r) for r in df.sparkSession.table(name).collect())


def test_repeated_events_and_sessions(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [(1, "2024-01-01 00:00:00", 1), (2, "2024-01-01 00:00:30", 1), (2, "2024-01-01 00:00:30", 1)], 0)
    write(spark, path, [(3, "2024-01-01 00:10:00", 1), (1, "2024-01-01 00:00:00", 1), (4, "2024-01-02 00:00:00", 2)], 1)
    events = feeds.event_stream(spark, path, EVENT)
    assert [x[0] for x in run(feeds.unique_events(events), "unique_events")] == [1, 2, 3, 4]
    got = run(feeds.session_batches(feeds.unique_events(events), "task", "1 minute", None), "sessions")
    assert [(x[0], x[3]) for x in got] == [(1, 2), (1, 1)]  # the last session is still open
    assert [(x[1], x[2]) for x in run(feeds.tumbling_counts(events, "task", "5 minutes"), "tumbling")] == [(1, 4), (1, 1)]


def test_generations(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    for k, kinds in enumerate((["change", "rename"], ["rescan", "change"])):
        spark.createDataFrame([("p", x) for x in kinds], "path string, kind string").coalesce(1).write.mode("append").parquet(path)
    changes = feeds.event_stream(spark, path, "path string, kind string")
    q = feeds.refresh_each(changes, lambda df, g: seen.append((g, [tuple(r) for r in df.collect()])), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(x[1][0][1] for x in seen) == ["rename", "rescan"] and sorted(x[0] for x in seen) == [0, 1]
