from pyspark.sql import functions as F

from quarry.streaming import activity


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def _stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "events")
    events.coalesce(1).write.parquet(path)
    return events, spark.readStream.schema(events.schema).parquet(path)


def _run(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append" if name != "windowed" else "complete").start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_windows_equal_their_batch_twin(spark, sf, tmp_path):
    table, stream = _stream(spark, sf, tmp_path)
    got = _run(spark, activity.windowed(stream), "windowed")
    assert rows(got, "window_start", "event_type", "n") == rows(activity.windowed(table), "window_start", "event_type", "n")


def test_closed_sessions_are_among_the_batch_twin(spark, sf, tmp_path):
    table, stream = _stream(spark, sf, tmp_path)
    got = set(rows(_run(spark, activity.sessions(stream), "closed"), "user_id", "start", "end", "n"))
    assert got <= set(rows(activity.sessions(table), "user_id", "start", "end", "n"))


def test_late_rows_are_kept_apart(spark, sf, tmp_path):
    _, stream = _stream(spark, sf, tmp_path)
    seen = []
    late = lambda df: df.withColumn("late", F.col("event_id") % 10 == 0)
    query = activity.start_with_late_log(stream, late, lambda df, n: seen.append(df.count()), str(tmp_path / "late"), str(tmp_path / "cp"))
    query.awaitTermination()
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    assert sum(seen) + spark.read.parquet(str(tmp_path / "late")).count() == total


def test_changed_days(spark, sf, tmp_path):
    table, _ = _stream(spark, sf, tmp_path)
    bursts = activity.changed_days(table, "3 hours")
    assert bursts.agg(F.sum("edits")).first()[0] == table.count()


def _confirm(spark, path, number, *rows):
    spark.createDataFrame([(d, a, r) for d, a, r in rows], "day date, at timestamp, rows string").coalesce(1).write.parquet(f"{path}/{number}")


def test_confirmations_emit_what_differs_from_the_kept_snapshot(spark, tmp_path):
    import datetime as dt
    import json

    from quarry.streaming import baseline

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    day, other, at = dt.date(2024, 1, 1), dt.date(2024, 1, 2), lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    one, two = {"a": {"name": "x", "n": "1"}, "b": {"name": "y"}}, {"a": {"name": "x", "n": "2"}, "c": {"name": "z"}}

    def run():
        stream = spark.readStream.schema("day date, at timestamp, rows string").option("recursiveFileLookup", "true").parquet(str(path))
        query = baseline.confirmed_changes(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        query.awaitTermination()
        found = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)
        return found

    _confirm(spark, path, 1, (day, at(0), json.dumps(one)))
    first = run()
    assert [(r[0], r[2]) for r in first] == [(day, "confirmed")]  # nothing to compare with: one silent line
    _confirm(spark, path, 2, (day, at(1), json.dumps(two)), (other, at(1), json.dumps(one)), (day, at(0, 1), json.dumps(one)))
    second = [r for r in run() if r not in first]
    assert sorted((r[0], *r[2:]) for r in second if r[0] == day) == sorted([(day, "created", "c", None, None, None), (day, "deleted", "b", None, None, None), (day, "updated", "a", "n", "1", "2")])
    assert [(r[2]) for r in second if r[0] == other] == ["confirmed"]
    _confirm(spark, path, 3, (other, at(0, 5), json.dumps(two)))
    assert [r[2] for r in run() if r not in first + second] == ["stale"]
    _confirm(spark, path, 4, (dt.date(2024, 5, 1), at(120), "{}"))  # moves the watermark past 60 days
    run()
    _confirm(spark, path, 5, (dt.date(2024, 5, 2), at(121), "{}"))
    known = run()
    _confirm(spark, path, 6, (day, at(122), json.dumps(one)))
    assert [r[2] for r in run() if r not in known] == ["confirmed"]  # the day's snapshot is gone


def test_snapshots_of_a_table(spark):
    import datetime as dt
    import json

    from quarry.streaming import baseline

    rows = [(dt.date(2024, 1, 1), dt.datetime(2024, 1, 1), e, {"k": v}) for e, v in (("b", "1"), ("a", None))]
    made = baseline.confirmations(spark.createDataFrame(rows, "day date, at timestamp, entity string, fields map<string,string>")).collect()
    assert json.loads(made[0]["rows"]) in ({"a": {"k": None}, "b": {"k": "1"}}, {"a": {}, "b": {"k": "1"}})
