"""Logs that grow while they are read, and the state of runs from snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from runledger import schemas
from runledger.operators import history
from runledger.operators.state import Snapshots, merge, state_of, summarize
from runledger.plans.bridge import view
from runledger.plans.queries import state_writes
from runledger.session import temporary_conf
from runledger.sources.tables import append_state
from runledger.streaming import growing

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    with temporary_conf(spark, {"spark.sql.shuffle.partitions": "2"}):
        yield


def state_rows(df):
    return sorted(map(tuple, df.select("run_id", "status", "finished_at", "exit_code").collect()), key=str)


def write(spark, rows):
    return spark.createDataFrame(rows, "run_id long, changed_at string, pri int, status string, finished_at string, exit_code int") \
        .withColumns({c: F.col(c).cast("timestamp") for c in ("changed_at", "finished_at")})


def test_ranges_own_the_lines_that_end_in_them(tmp_path):
    text = "one\n\ntwo\r\n" + "x" * 50 + "\nünï\nlast without end"
    (tmp_path / "a.log").write_bytes(text.encode())
    files, place = growing.fs.FileSystem.from_uri(f"file://{tmp_path}/a.log")
    size = len(text.encode())
    whole = list(growing.finished_lines(files, growing.Range(place, 0, size)))
    assert [line for _, _, line in whole] == ["one", "two", "x" * 50, "ünï"]
    assert [at for _, at, _ in whole] == [0, 5, 10, 61]
    for step in (1, 2, 3, 7, 16, 51):
        parts = growing.ranges({}, {place: size}, step)
        assert [row for p in parts for row in growing.finished_lines(files, p)] == whole
    with pytest.raises(ValueError, match="only grow"):
        growing.ranges({place: 9}, {place: 8}, 4)


@pytest.mark.parametrize("tail", [3, 1500])
def test_tail_then_follow_has_no_gap_and_no_repeat(spark, tmp_path, tail):
    """Files grow in the middle of a line, before and after the hand-over, and new ones appear."""
    logs = tmp_path / "logs"
    logs.mkdir()
    chance = random.Random(5)
    whole = {f"{name}.log": "".join(f"{name} line {n} {'y' * chance.randrange(90)}\n" for n in range(2000)) for name in "abc"}
    given = dict.fromkeys(whole, 0)

    def grow(name, size):
        with open(logs / name, "a", newline="") as out:
            out.write(whole[name][given[name]:given[name] + size])
        given[name] += size

    grow("a.log", 100_003)
    grow("b.log", 17)
    before = dict(given)
    last, following = growing.tail_then_follow(spark, str(logs), tail, split_bytes=16384)
    # These bytes come after the hand-over, but before anything is read.
    grow("a.log", 1)
    grow("b.log", 5_000)
    shown = last.collect()
    for step in (0, 7_001, 10**6):
        for name in whole:
            grow(name, step)
        query = (
            following.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True).start(str(tmp_path / "out"))
        )
        assert query.awaitTermination(120)
        assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    for name, text in whole.items():
        lines = text.splitlines()
        finished = text[:before[name]].count("\n")
        count = finished if tail == "all" else min(finished, tail)
        of = lambda rows: [r["line"] for r in sorted(rows, key=lambda r: r["at"]) if r["file"].endswith("/" + name)]
        assert of(shown) == lines[finished - count:finished]
        assert of(got) == lines[finished:]


@pytest.mark.parametrize("policy", ["last_writer", "first_terminal"])
def test_summaries_of_parts_merge_to_the_state(spark, policy):
    writes = state_writes(view("job_runs", spark, SF))
    parts = [writes.where(F.pmod(F.xxhash64("run_id", "pri"), F.lit(3)) == k) for k in range(3)]
    whole = state_rows(history.current_state(writes, policy))
    assert state_rows(state_of(summarize(writes), policy)) == whole
    # Also in another order, and with a part twice.
    merged = merge(summarize(parts[2]), summarize(parts[0]), summarize(parts[1]), summarize(parts[0]))
    assert state_rows(state_of(merged, policy)) == whole
    with pytest.raises(ValueError):
        state_of(merged, "newest")


def test_snapshots_take_in_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "writes")
    snapshots = Snapshots(str(tmp_path / "snapshots"), path, buckets=4)
    append_state(write(spark, [(k, "2024-01-01 00:00:00", 0, "running", None, None) for k in range(40)]), path)
    assert snapshots.state(spark).count() == 0
    assert snapshots.refresh(spark) == 0
    assert snapshots.refresh(spark) == 0
    old = {file for file in snapshots.summary(spark).inputFiles()}

    # One run ends; only its bucket is written anew, and the files of old writes are not read: they are gone.
    append_state(write(spark, [(7, "2024-01-01 02:00:00", 2, "failed", "2024-01-01 02:00:00", 143)]), path)
    plans = []
    original = summarize.__globals__["summarize"]
    summarize.__globals__["summarize"] = lambda rows: plans.append(set(rows.inputFiles())) or original(rows)
    try:
        assert snapshots.refresh(spark) == 1
    finally:
        summarize.__globals__["summarize"] = original
    (read,) = plans
    assert len(read) < len(spark.read.parquet(path).inputFiles())
    assert len(set(snapshots.summary(spark).inputFiles()) - old) == 1

    # A real exit that comes late, an end from before the stop, a repeat and an unknown run.
    append_state(write(spark, [
        (7, "2024-01-01 03:00:00", 3, "success", "2024-01-01 03:00:00", 0),
        (7, "2024-01-01 01:00:00", 3, "error", "2024-01-01 01:00:00", None),
        (8, "2024-01-01 00:00:00", 0, "running", None, None), (99, "2024-01-02 00:00:00", 3, "success", "2024-01-02 00:00:00", 0),
    ]), path)
    assert snapshots.refresh(spark) == 2
    writes = spark.read.schema(schemas.LIFECYCLE).parquet(path)
    for policy in ("last_writer", "first_terminal"):
        assert state_rows(snapshots.state(spark, policy)) == state_rows(history.current_state(writes, policy))
    assert snapshots.state(spark, version=0).where("status <> 'running'").count() == 0


def test_a_refresh_that_failed_is_done_again(spark, tmp_path):
    path = str(tmp_path / "writes")
    snapshots = Snapshots(str(tmp_path / "snapshots"), path, buckets=2)
    append_state(write(spark, [(1, "2024-01-01 00:00:00", 0, "running", None, None)]), path)
    snapshots.refresh(spark)
    # Left behind by a refresh that ended before its list of buckets was written.
    wrong = summarize(write(spark, [(1, "2030-01-01 00:00:00", 3, "error", None, 9)]))
    wrong.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(snapshots._folder("runs", 1))
    names = spark.read.parquet(path).inputFiles()
    append_state(write(spark, [(1, "2024-01-01 05:00:00", 3, "success", "2024-01-01 05:00:00", 0)]), path)
    added = [(f,) for f in spark.read.parquet(path).inputFiles() if f not in names]
    spark.createDataFrame(added, "file string").write.parquet(snapshots._folder("files", 1))
    assert snapshots.version(spark) == 0
    assert [r["status"] for r in snapshots.state(spark).collect()] == ["running"]
    assert snapshots.refresh(spark) == 1
    assert [(r["status"], r["exit_code"]) for r in snapshots.state(spark).collect()] == [("success", 0)]
