"""The streaming feed against the batch operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from runledger import default_registry, schemas
from runledger.operators import history, logs
from runledger.plans.bridge import view
from runledger.session import temporary_conf
from runledger.sources import tables
from runledger.streaming import batches, feed, outcomes

REGISTRY = default_registry()
SF = "/root/testdata/sf0.001"
SIX_HOURS = 6 * 3600.0


@pytest.fixture(autouse=True)
def few_partitions(spark):
    with temporary_conf(spark, {"spark.sql.shuffle.partitions": "2"}):
        yield


def run_to_end(spark, stream, tmp_path, **options):
    out = str(tmp_path / "events")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True).start(out)
    )
    assert query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(out)


def rows_of(df):
    columns = ["job_id", "seq", "sub", "event_type", "text", "num"]
    return sorted(map(tuple, df.select(columns).collect()))


@pytest.fixture()
def line_files(spark, tmp_path):
    """The bridge log as four files in order of arrival."""
    lines = view("job_log_lines", spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "lines")
    for part in range(4):
        one = lines.where((F.col("seq") >= part * 250) & (F.col("seq") < part * 250 + 250))
        one.coalesce(1).write.mode("append").parquet(path)
    return lines, path


def test_feed_equals_batch(spark, tmp_path, line_files):
    lines, path = line_files
    stream = (
        spark.readStream.schema(schemas.LOG_LINES).option("maxFilesPerTrigger", 1).parquet(path)
    )
    got = run_to_end(spark, feed.follow(stream, REGISTRY, SIX_HOURS), tmp_path)
    expected = logs.job_events(lines, REGISTRY, interval_sec=SIX_HOURS)
    assert rows_of(got) == rows_of(expected)
    assert got.where("event_type = 'log'").count() > 0
    assert got.where("event_type = 'progress'").count() > 0
    assert got.where("event_type = 'heartbeat'").count() > 0


def test_live_beats_stop_when_a_run_stays_silent(spark, tmp_path):
    path = str(tmp_path / "lines")
    start = dt.datetime(2024, 1, 1)
    spark.createDataFrame(
        [(1, 0, start, "retired-tool", "hello")], schemas.LOG_LINES
    ).write.parquet(path)
    stream = spark.readStream.schema(schemas.LOG_LINES).parquet(path)
    events = feed.follow(stream, REGISTRY, idle_seconds=0.5, live_beats=True, give_up_seconds=1.0)
    query = (
        events.writeStream.format("memory").queryName("beats").outputMode("append")
        .trigger(processingTime="300 milliseconds").start()
    )
    try:
        deadline = dt.datetime.now() + dt.timedelta(seconds=60)
        while dt.datetime.now() < deadline:
            kinds = [r.event_type for r in spark.table("beats").collect()]
            if kinds.count("heartbeat") == 2:
                break
            query.awaitTermination(1)
        query.awaitTermination(3)
        kinds = sorted(r.event_type for r in spark.table("beats").collect())
        assert kinds == ["heartbeat", "heartbeat", "log"]
    finally:
        query.stop()


def test_silent_runs_can_be_forgotten(spark, tmp_path):
    """After its state is gone, a run's progress counts as new again."""
    path = str(tmp_path / "lines")
    start = dt.datetime(2024, 1, 1)

    def add(seq):
        line = (1, seq, start, "abstec-suite", "Progress: 50%")
        spark.createDataFrame([line], schemas.LOG_LINES).write.mode("append").parquet(path)

    add(0)
    stream = spark.readStream.schema(schemas.LOG_LINES).parquet(path)
    query = (
        feed.follow(stream, REGISTRY, forget_after_seconds=2.0).writeStream.format("memory")
        .queryName("forgotten").trigger(processingTime="200 milliseconds").start()
    )

    def wait_for(count):
        deadline = dt.datetime.now() + dt.timedelta(seconds=60)
        while dt.datetime.now() < deadline and spark.table("forgotten").count() < count:
            query.awaitTermination(1)

    try:
        wait_for(2)
        query.awaitTermination(4)
        add(1)
        wait_for(4)
        kinds = sorted(r.event_type for r in spark.table("forgotten").collect())
        assert kinds == ["log", "log", "progress", "progress"]
    finally:
        query.stop()


def test_outcomes_are_recorded(spark, tmp_path):
    notices, state = str(tmp_path / "exits"), str(tmp_path / "state")
    at = dt.datetime(2024, 1, 1, 12)
    schema = "run_id LONG, ts TIMESTAMP, stream_code INT, looked_up_code INT"
    spark.createDataFrame(
        [(1, at, 0, None), (2, at, None, 3), (3, at, None, None)], schema
    ).write.parquet(notices)
    runs = spark.createDataFrame([(i, at - dt.timedelta(hours=1)) for i in (1, 2, 3, 4)],
                                 "id LONG, started_at TIMESTAMP")
    tables.append_state(history.start_writes(runs), state)
    exits = spark.readStream.schema(schema).parquet(notices)
    for attempt in ("a", "b"):  # the second delivery changes nothing
        query = outcomes.record_outcomes(exits, state, str(tmp_path / attempt))
        query.awaitTermination(120)
        assert query.exception() is None
    now = history.current_state(tables.read_state_writes(spark, state))
    got = {r.run_id: (r.status, r.exit_code) for r in now.collect()}
    assert got == {1: ("success", 0), 2: ("failed", 3), 3: ("failed", -1), 4: ("running", None)}


def test_seeded_batches_equal_one_batch(spark, tmp_path, line_files):
    """Four micro-batches, each seeded with the state before it; pauses count from the start of a run."""
    lines, path = line_files
    first = lines.agg(F.min("ts").alias("t")).collect()[0].t
    jobs = [r.job_id for r in lines.select("job_id").distinct().collect()]
    begun = spark.createDataFrame([(j, first - dt.timedelta(hours=j)) for j in jobs], "job_id LONG, started_at TIMESTAMP")
    stream = spark.readStream.schema(schemas.LOG_LINES).option("maxFilesPerTrigger", 1).parquet(path)
    out = batches.Feed(str(tmp_path / "feed"))
    query = batches.follow_batches(
        stream, REGISTRY, out, str(tmp_path / "checkpoint"), interval_sec=SIX_HOURS, started=lambda: begun
    )
    assert query.awaitTermination(240) and query.exception() is None
    expected = rows_of(logs.job_events(lines, REGISTRY, interval_sec=SIX_HOURS, started=begun))
    assert rows_of(out.events(spark)) == expected
    assert out.late(spark).count() == 0
    assert len(list((tmp_path / "feed" / "events").iterdir())) == 4
    # A batch that runs again from an older checkpoint changes nothing.
    for kind in ("commits", "offsets"):
        for name in ("3", ".3.crc"):
            if kind == "commits":
                (tmp_path / "checkpoint" / kind / name).unlink(missing_ok=True)
    query = batches.follow_batches(
        stream, REGISTRY, out, str(tmp_path / "checkpoint"), interval_sec=SIX_HOURS, started=lambda: begun
    )
    assert query.awaitTermination(240) and query.exception() is None
    assert rows_of(out.events(spark)) == expected


def test_late_and_repeated_lines_go_aside(spark, tmp_path):
    path, start = str(tmp_path / "lines"), dt.datetime(2024, 1, 1)
    out, checkpoint = batches.Feed(str(tmp_path / "feed")), str(tmp_path / "checkpoint")

    def run(*lines):
        rows = [(1, seq, start + dt.timedelta(seconds=seq), "abstec-suite", text) for seq, text in lines]
        spark.createDataFrame(rows, schemas.LOG_LINES).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schemas.LOG_LINES).parquet(path)
        query = batches.follow_batches(stream, REGISTRY, out, checkpoint, ended=lambda: gone)
        assert query.awaitTermination(120) and query.exception() is None

    gone = spark.createDataFrame([], "job_id LONG")
    run((0, "Progress: 10%"), (1, "Progress: 20%"), (1, "Progress: 90%"), (40, "Progress: 30%"))
    run((2, "Progress: 99%"), (40, "Progress: 99%"), (41, ""), (42, "Progress: 30%"), (43, "Progress: 31%"))
    assert sorted(r.seq for r in out.late(spark).collect()) == [1, 2, 40]
    got = [(r.seq, r.event_type, r.num) for r in out.events(spark).orderBy("seq", "sub").collect()]
    assert [(s, n) for s, kind, n in got if kind == "heartbeat"] == [(40, 2)]
    progress = [(s, n) for s, kind, n in got if kind == "progress"]
    assert progress[0] == (0, 10) and progress[-2:] == [(40, 30), (43, 31)]
    assert out.state(spark, 1).collect()[0].last_seq == 43
    gone = spark.createDataFrame([(1,)], "job_id LONG")
    run((50, "Progress: 32%"),)
    assert out.state(spark, 2).count() == 0


def test_pause_before_the_first_line(spark):
    start = dt.datetime(2024, 1, 1)
    lines = spark.createDataFrame(
        [(job, 0, start + dt.timedelta(seconds=s), "tec-suite", "x") for job, s in ((1, 46), (2, 14), (3, 900))],
        schemas.LOG_LINES,
    )
    begun = spark.createDataFrame([(1, start), (2, start), (9, start)], "job_id LONG, started_at TIMESTAMP")
    events = logs.job_events(lines, REGISTRY, started=begun).where("event_type = 'heartbeat'").collect()
    assert [(r.job_id, r.seq, r.num) for r in events] == [(1, 0, 3)]


def test_a_batch_tries_patterns_once(spark, tmp_path, monkeypatch):
    """Each operator of a batch reads the marked lines; none goes back to the patterns."""
    plans, events = [], batches.line_events

    def seen(lines, *rest):
        plans.append(lines._jdf.queryExecution().optimizedPlan().toString())
        return events(lines, *rest)

    monkeypatch.setattr(batches, "line_events", seen)
    path = str(tmp_path / "lines")
    spark.createDataFrame(
        [(1, 0, dt.datetime(2024, 1, 1), "tec-suite", "Completed 1 / 2: a")], schemas.LOG_LINES
    ).write.parquet(path)
    out = batches.Feed(str(tmp_path / "feed"))
    batches.follow_batches(
        spark.readStream.schema(schemas.LOG_LINES).parquet(path), default_registry(), out, str(tmp_path / "checkpoint")
    ).awaitTermination()
    assert sorted(r.event_type for r in out.events(spark).collect()) == ["log", "progress"]
    assert plans and not any("RLIKE" in plan.split("InMemoryRelation")[0] for plan in plans)
