from weftline.operators import reconcile
from weftline.plans import sessions
from weftline.streaming import streams

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def test_usage_increments_keep_state_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    schema = "document_id string, seq bigint, total bigint"
    spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 1, 7)], schema).coalesce(1).write.mode("append").parquet(str(src))
    for rows in ([("a", 3, 9), ("b", 2, 2)], []):
        s = streams.usage_increments(spark.readStream.schema(schema).parquet(str(src)))
        out = s.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        out.awaitTermination()
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [("a", 1, 5), ("a", 3, 4), ("b", 1, 7), ("b", 2, 2)]


def test_follow_sources_commits_each_batch_once(spark, tmp_path):
    src, store = tmp_path / "src", reconcile.Store(spark, str(tmp_path / "store"))
    src.mkdir()
    (src / "a.jsonl").write_text("{}\n")

    def process(d):
        return {"seen": d.select("path", "fingerprint")}

    for _ in range(2):
        streams.follow_sources(spark, str(src), "*.jsonl", store, process, str(tmp_path / "ck")).awaitTermination()
    assert store.generation == 1 and store.table("seen").count() == 1
    (src / "b.jsonl").write_text("{}\n{}\n")
    streams.follow_sources(spark, str(src), "*.jsonl", store, process, str(tmp_path / "ck")).awaitTermination()
    assert store.generation == 2 and store.table("seen").count() == 1


def test_stream_sessions_do_not_pass_through_the_driver(spark, tmp_path):
    n, conf = 60_000, spark.sparkContext._jsc.sc().conf()
    spark.range(n).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id AS user_id", "'view' AS event_type", "1D AS value", "'{}' AS props").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "events.parquet")
    most = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "1m")
    try:
        out = sessions.stream_sessions(spark, str(tmp_path))
        assert out.count() == out.select("user_id").distinct().count() == n
    finally:
        conf.set("spark.driver.maxResultSize", most)


def test_stream_sessions_read_a_folder_and_part_at_a_full_gap(spark, tmp_path):
    for rows in ([(1, 0), (1, 1799), (2, 0)], [(1, 3599), (2, 1800)]):
        df = spark.createDataFrame(rows, "user_id bigint, s int")
        df = df.selectExpr("1L AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS ts", "user_id", "'view' AS event_type", "1D AS value", "'{}' AS props")
        df.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.user_id, (r.end_us - r.start_us) // 10**6, r.n) for r in sessions.stream_sessions(spark, str(tmp_path)).collect())
    assert got == [(1, 1800, 1), (1, 3599, 2), (2, 1800, 1), (2, 1800, 1)]


def test_run_once_of_no_input_gives_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = streams.run_once(streams.sessions(streams.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], EVENTS).schema), "30 minutes", "user_id"), "none", "complete", str(tmp_path / "ck"))
    assert out.count() == 0 and out.columns == ["user_id", "start", "end", "n", "total"]
