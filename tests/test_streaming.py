from karst.streaming.current import distinct_events, latest, window_counts

SCHEMA = "k long, ts timestamp, id long, kind string, value double"


def run(spark, tmp_path, build, mode, name):
    data = spark.sql("select * from values (1L, timestamp'2024-01-01 10:00', 1L, 'NEW', 1.0D), (1L, timestamp'2024-01-01 12:00', 2L, 'END', 2.0D), (2L, timestamp'2024-01-01 11:00', 3L, 'NEW', 3.0D), (2L, timestamp'2024-01-01 11:00', 3L, 'NEW', 3.0D) t(k, ts, id, kind, value)")
    data.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = build(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_latest(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: latest(s, "k", ["ts", "id"], "kind = 'END'"), "complete", "t_latest")
    assert [(r[0], r[2], r[-1]) for r in got] == [(1, 2, True), (2, 3, False)]


def test_distinct_then_windows(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: distinct_events(s, ["id"]).select("id", "k"), "append", "t_distinct")
    assert [r[0] for r in got] == [1, 2, 3]
    got = run(spark, tmp_path / "w", lambda s: window_counts(s, "k"), "complete", "t_windows")
    assert [(r[1], r[2]) for r in sorted(got, key=lambda r: (r[1], r[0]))] == [(1, 1), (1, 1), (2, 2)]
