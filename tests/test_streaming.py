from korpora.streaming import feedback as S


def lines(folder, name, n, start=0):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(f'{{"patent": "p", "segment_id": {start + i}}}\n' for i in range(n)))


def test_merge_at_threshold(spark, tmp_path):
    log, pending, training = tmp_path / "log", str(tmp_path / "pending"), str(tmp_path / "training")
    lines(log, "a.jsonl", 12)
    run = lambda: S.merge_at_threshold(S.events(spark, str(log)), pending, training, str(tmp_path / "c")).awaitTermination()
    run()
    assert spark.read.parquet(pending).count() == 12 and not (tmp_path / "training").exists()
    lines(log, "b.jsonl", 9, 12)
    run()
    assert spark.read.parquet(training).select("segment_id").distinct().count() == 21 and not (tmp_path / "pending").exists()


def test_event_time(spark, tmp_path):
    d = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(d).withColumn("ts", __import__("pyspark.sql.functions", fromlist=["x"]).col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    total = S.drained(S.windowed(stream), "by_window", "complete", str(tmp_path / "c1"))
    assert total.agg({"n": "sum"}).head()[0] == batch.count()
    users = S.drained(S.first_use(stream.selectExpr("user_id AS code", "ts")), "by_code", "update", str(tmp_path / "c2"))
    assert users.agg({"used": "sum"}).head()[0] == batch.count()
    assert users.selectExpr("min(first_use)").head()[0] == batch.selectExpr("min(ts)").head()[0]
    assert S.drained(S.sessions(stream), "by_session", "append", str(tmp_path / "c3")).count() > 0


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """A crash after training was written, before or after pending went, and before the stream knew."""
    pending, training = str(tmp_path / "p"), str(tmp_path / "t")
    batch = lambda a, b: spark.range(a, b)
    rows = lambda p: sorted(r.id for r in spark.read.schema("id long").parquet(p).collect())
    S.merge_batch(batch(0, 3), 0, pending, training, 5)
    S.merge_batch(batch(0, 3), 0, pending, training, 5)
    assert rows(pending) == [0, 1, 2]
    S.merge_batch(batch(3, 6), 1, pending, training, 5)
    S.merge_batch(batch(3, 6), 1, pending, training, 5)
    assert rows(training) == list(range(6)) and not S.folders(spark, pending)
    batch(3, 6).write.parquet(f"{pending}/batch=1")
    S.merge_batch(batch(6, 8), 2, pending, training, 5)
    assert rows(training) == list(range(6)) and rows(pending) == [6, 7]


def test_missing_texts_are_filled_once(spark, tmp_path):
    log, target, schema = tmp_path / "log", str(tmp_path / "target"), "id long, src string, mt string"
    log.mkdir()
    given = []

    def fill(rows):
        got = sorted(r.id for r in rows.collect())
        given.append(got)
        if len(given) == 2:
            raise RuntimeError("the service is down")
        return rows.selectExpr("id", "src", "if(id % 4 = 3, NULL, upper(src)) AS mt")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(log))
        S.fill_missing(stream, target, str(tmp_path / "c"), "id", "mt", fill).awaitTermination()

    (log / "a.json").write_text("".join(f'{{"id": {i}, "src": "s{i}"}}\n' for i in (1, 2, 3, 3)) + '{"id": 9, "src": "x", "mt": "there"}\n')
    run()
    (log / "b.json").write_text("".join(f'{{"id": {i}, "src": "s{i}"}}\n' for i in (2, 3, 4)))
    try:
        run()
        raise AssertionError
    except Exception as e:
        assert "down" in str(e)
    run()
    assert given == [[1, 2, 3], [3, 4], [3, 4]]
    S.fill_batch(spark.createDataFrame([(3, "s3", None), (4, "s4", None)], schema), 1, target, "id", "mt", lambda rows: rows.selectExpr("id", "src", "upper(src) AS mt"))
    assert sorted((r.id, r.mt) for r in S.filled(spark, target, schema, "id", "mt").collect()) == [(1, "S1"), (2, "S2"), (3, "S3"), (4, "S4")]
