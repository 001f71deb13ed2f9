import datetime as dt
import gzip
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runledger import Converter, Registry, default_registry, schemas
from runledger.operators import logs
from runledger.operators import throttle as throttle_module
from runledger.operators.throttle import composed, throttle
from runledger.session import temporary_conf
from runledger.sources.logs import lines_from_bytes, read_log_text, stream_log_text

REGISTRY = default_registry()
EPOCH = dt.datetime(2024, 1, 1)


def lines_df(spark, rows):
    """Lines from ``(job, seq, microseconds, converter, text)``."""
    data = [(j, s, EPOCH + dt.timedelta(microseconds=us), c, t) for j, s, us, c, t in rows]
    return spark.createDataFrame(data, schemas.LOG_LINES)


def test_filter_and_progress(spark):
    rows = [
        (1, 0, 0, "dat-parquet-handler", "INFO: Completed 3 / 9"),
        (1, 1, 1, "dat-parquet-handler", ""),
        (1, 2, 2, "dat-parquet-handler", "   "),
        (2, 3, 3, "abstec-suite", "INFO: Completed 3 / 9"),  # not recognised here
        (2, 4, 4, "abstec-suite", "progress: 17 %"),
        (3, 5, 5, "retired-tool", "anything"),
        (3, 6, 6, None, "no converter"),
    ]
    df = lines_df(spark, rows)
    assert sorted(r.seq for r in logs.matching_lines(df, REGISTRY).collect()) == [0, 4, 5, 6]
    got = {r.seq: r.progress for r in logs.with_progress(df, REGISTRY).collect()}
    assert got == {0: 33, 2: None, 3: None, 4: 17, 5: None, 6: None}


def test_a_converter_is_added_by_a_row(spark):
    own = Registry((Converter("mine", "Mine", (r"step (\d+) of (\d+)",), emit_interval_sec=0.0),))
    df = lines_df(spark, [(1, 0, 0, "mine", "Step 1 of 4"), (1, 1, 1, "mine", "x")])
    got = logs.with_progress(df, own).orderBy("seq").collect()
    assert [r.progress for r in got] == [25, None]
    assert logs.matching_lines(df, own).count() == 1
    # Its interval of zero shows every line.
    assert throttle(df, own).count() == 2


def test_monotonic_progress(spark):
    values = [10, 5, 10, 20, 20, 19, 50, 3, 100, 99]
    rows = [(1, i, i, "abstec-suite", f"Progress: {v}%") for i, v in enumerate(values)]
    got = logs.monotonic_progress(lines_df(spark, rows).repartition(4), REGISTRY).orderBy("seq")
    assert [(r.seq, r.progress) for r in got.collect()] == [(0, 10), (3, 20), (6, 50), (8, 100)]


def test_hot_run_is_reduced_before_the_shuffle(spark):
    df = lines_df(spark, [(1, 0, 0, "abstec-suite", "Progress: 1%")])
    for reduced in (logs.monotonic_progress(df, REGISTRY), logs.idle_beats(df)):
        plan = reduced._jdf.queryExecution().executedPlan().toString()
        first_exchange_from_below = plan[plan.rindex("Exchange"):]
        assert "partial_min" in first_exchange_from_below


def test_idle_beats(spark):
    s = 1_000_000
    at = [0, 14 * s, 29 * s, 29 * s, 29 * s + 15 * s - 1, 60 * s + 29 * s, 400 * s]
    rows = [(1, i, us, "x", "line") for i, us in enumerate(at)]
    rows.append((1, 99, 70 * s, "x", ""))  # empty lines are no sign of life
    rows.append((2, 0, 10 * s, "x", "other run"))
    got = {(r.job_id, r.seq): r.beats for r in logs.idle_beats(lines_df(spark, rows)).collect()}
    assert got == {(1, 2): 1, (1, 5): 3, (1, 6): 20}


@pytest.mark.parametrize("tail, kept", [("all", 9), (3, 3), ("2", 2), (0, 0), (-4, 0), (100, 9)])
def test_tail(spark, tail, kept):
    rows = [(1, i, i, "x", f"l{i}") for i in range(9)] + [(1, 9, 9, "x", "")]
    got = logs.tail_lines(lines_df(spark, rows), tail)
    assert sorted(r.seq for r in got.collect()) == list(range(9 - kept, 9))


def test_tail_rejects_other_text():
    with pytest.raises(ValueError):
        logs.parse_tail("ten")


@pytest.mark.parametrize("count", [1, 5, 16, 17, 40])
def test_long_tail_counts_blocks(spark, count):
    """Blocks of eight, so that the tail starts inside, at the edge of, and before blocks."""
    rng = random.Random(count)
    rows = [(job, seq, seq, "x", "t") for job in range(4) for seq in sorted(rng.sample(range(60), 3 + job * 11))]
    df = lines_df(spark, rows).repartition(4)
    with temporary_conf(spark, {"spark.sql.optimizer.windowGroupLimitThreshold": "0"}):
        got = {(r.job_id, r.seq) for r in logs.tail_lines(df, count, block=8).collect()}
    expected = set()
    for job in range(4):
        seqs = sorted(s for j, s, *_ in rows if j == job)
        expected |= {(job, s) for s in seqs[-count:]}
    assert got == expected


def brute_force_throttle(rows, gap):
    kept, last = set(), {}
    for job, seq, us, *_ in sorted(rows, key=lambda r: (r[0], r[1])):
        if job not in last or us - last[job] >= gap:
            kept.add((job, seq))
            last[job] = us
    return kept


def throttled(df, gap_us, **slices):
    got = throttle(df, REGISTRY, gap_us / 1e6, **slices).collect()
    assert len({(r.job_id, r.seq) for r in got}) == len(got)
    return {(r.job_id, r.seq) for r in got}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    gaps=st.lists(st.lists(st.integers(0, 30), max_size=80), min_size=1, max_size=4),
    gap=st.integers(1, 700), slice_rows=st.integers(1, 4),
)
def test_throttle_equals_brute_force(spark, gaps, gap, slice_rows):
    """Slices of a few lines cut each run many times; long gaps let buckets rule out lines."""
    rows = []
    for job, steps in enumerate(gaps):
        us = 0
        for seq, step in enumerate(steps):
            us += step
            rows.append((job, seq, us, "retired-tool", "x"))
    df = lines_df(spark, rows)
    got = throttled(df, gap, slice_rows=slice_rows, bucket_us=3)
    assert got == brute_force_throttle(rows, gap)


def test_throttle_of_a_hot_run_over_many_batches(spark):
    """One run holds most lines; groups and batches end in different places."""
    rng = random.Random(7)
    rows, us = [], 0
    for seq in range(20_000):
        us += rng.choice([0, 1, 2, 5, 40, 900])
        rows.append((1, seq, us, "retired-tool", "x"))
    rows += [(j, i, i * 7, "retired-tool", "x") for j in range(2, 40) for i in range(j)]
    df = lines_df(spark, rows).repartition(8)
    expected = brute_force_throttle(rows, 1000)
    with temporary_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "37"}):
        assert throttled(df, 1000, slice_rows=300, bucket_us=50) == expected
        assert throttled(df, 1000, slice_rows=1, bucket_us=1) == expected
    assert throttled(df, 1000) == expected


def test_runs_of_one_slice_take_no_step_of_their_own(monkeypatch):
    """Most runs are short; a step in Python for each of them is what many runs cannot afford."""
    runs = 5000
    table = pa.table({
        "job_id": np.repeat(np.arange(runs), 2), "group": np.zeros(2 * runs, np.int64), "slice": np.zeros(2 * runs, np.int64),
        "upto": np.tile([5, 9], runs), "allowed": np.tile([12, 16], runs), "reach": np.full(2 * runs, 7),
        "start_us": np.repeat(np.arange(runs), 2),
    })
    monkeypatch.setattr(throttle_module, "_functions", None)
    composed = pa.Table.from_batches(throttle_module._compose(iter(table.to_batches(max_chunksize=777))))
    assert composed.num_rows == 2 * runs and composed.column_names == ["job_id", "slice", "upto", "allowed"]
    starts = pa.Table.from_batches(throttle_module._follow(["job_id"])(iter(table.to_batches(max_chunksize=777))))
    assert starts.column("start_us").to_pylist() == list(range(runs))


def test_instants_are_read_and_shuffled_once(spark):
    rows = [(j, i, i * 7, "tec-suite", "Completed 1 / 2: a") for j in range(3) for i in range(50)]
    timed = logs.matching_lines(lines_df(spark, rows), REGISTRY).withColumn("interval_us", F.lit(100).cast("bigint"))
    sliced = throttle_module.sliced_instants(timed, 50, None, 10)
    assert sliced.count() == 150
    sliced.collect()
    assert "ReusedExchange" in sliced._jdf.queryExecution().executedPlan().toString()


def test_functions_of_slices_compose(spark):
    """However slices are grouped, the composed function is the same where starts can lie."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        us = np.unique(rng.integers(0, 400, rng.integers(2, 120)))
        gap = int(rng.integers(1, 120))
        functions = []
        for part in np.array_split(us, rng.integers(1, 9)):
            if len(part):
                last = []
                for start in part:
                    shown = start
                    for x in part:
                        shown = x if x >= shown + gap else shown
                    last.append(shown + gap)
                functions.append((part, np.array(last)))
        reach = int(us[0]) + gap
        upto, allowed = composed(functions, reach)
        for start in range(-5, reach + 1):
            then = start
            for x in us:
                then = x + gap if x >= then else then
            k = np.searchsorted(upto, start)
            assert (allowed[k] if k < len(upto) else start) == then
        assert len(upto) <= len(functions[0][0]) + (us <= reach).sum() + 1


@pytest.mark.parametrize("gap_sec", [1, 6 * 3600])
def test_a_hot_run_is_spread(spark, gap_sec):
    """One run has all lines; no slice, group or bucket list comes near their number."""
    n, step_us = 500_000, 400_000 if gap_sec > 1 else 2_000
    lines = spark.range(0, n, 1, 16).select(
        F.lit(1).cast("bigint").alias("job_id"), F.col("id").alias("seq"),
        F.timestamp_micros(F.col("id") * step_us + F.pmod(F.xxhash64("id"), F.lit(step_us // 3))).alias("ts"),
        F.lit("retired-tool").alias("converter"), F.lit("x").alias("line"),
    )
    us = np.sort(lines.select(F.unix_micros("ts").alias("us")).toArrow().column("us").to_numpy())
    expected, k = [], 0
    while k < n:
        expected.append(k)
        k = int(np.searchsorted(us, us[k] + gap_sec * 1_000_000))
    shown = throttle(lines, REGISTRY, gap_sec, slice_rows=4096).select("seq").collect()
    assert sorted(r.seq for r in shown) == expected
    interval = gap_sec * 1_000_000
    timed = lines.withColumn("interval_us", F.lit(interval).cast("bigint"))
    sliced = throttle_module.sliced_instants(timed, max(10_000_000, interval // 1024), None, 4096)
    sizes = [r["count"] for r in sliced.groupBy("slice").count().collect()]
    if gap_sec == 1:
        assert sum(sizes) == n and max(sizes) < 4096 + 5001
        exits = throttle_module.grouped_exits(sliced)
        assert max(r["count"] for r in exits.groupBy("group").count().collect()) <= 64 * 502
    else:
        assert sum(sizes) < n / 20  # what no line shown can be among is left out


def test_throttle_from_a_seed(spark):
    rows = [(job, i, i * 400_000, "tec-suite", "x") for job in (1, 2) for i in range(8)]
    start = round(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    seeds = spark.createDataFrame([(1, start + 900_000), (3, 5)], "job_id LONG, allowed_us LONG")
    got = throttle(lines_df(spark, rows), REGISTRY, seeds=seeds).collect()
    assert sorted((r.job_id, r.seq) for r in got) == [(1, 3), (1, 5), (1, 7), (2, 0), (2, 2), (2, 4), (2, 6)]


def test_throttle_works_with_named_runs(spark):
    df = lines_df(spark, [(1, i, i * 400_000, "tec-suite", "x") for i in range(6)])
    named = df.withColumn("job_id", F.concat(F.lit("run-"), F.col("job_id").cast("string")))
    # Half a second by default: 0, 0.8, 1.6 s.
    assert sorted(r.seq for r in throttle(named, REGISTRY).collect()) == [0, 2, 4]


def test_throttle_off(spark):
    df = lines_df(spark, [(1, i, 0, "tec-suite", "x") for i in range(5)])
    assert throttle(df, REGISTRY, 0).count() == 5
    assert throttle(df, REGISTRY, -1).count() == 5


def test_events(spark):
    s = 1_000_000
    rows = [
        (1, 0, 0, "dat-parquet-handler", "Completed 1 / 4"),
        (1, 1, s // 2, "dat-parquet-handler", "Completed 2 / 4"),  # hidden, progress counts
        (1, 2, s, "dat-parquet-handler", "noise"),
        (1, 3, 40 * s, "dat-parquet-handler", "Completed 2 / 4"),
    ]
    ended = spark.createDataFrame(
        [(1, EPOCH, 0, None), (2, EPOCH, None, "gone")],
        "job_id LONG, ts TIMESTAMP, exit_code INT, error STRING",
    )
    feed = logs.job_events(lines_df(spark, rows), REGISTRY, ended)
    ordered = feed.orderBy("job_id", F.col("seq").asc_nulls_last(), "sub").collect()
    assert [(r.job_id, r.seq, r.event_type, r.text, r.num) for r in ordered] == [
        (1, 0, "log", "Completed 1 / 4", None), (1, 0, "progress", None, 25),
        (1, 1, "progress", None, 50),
        (1, 3, "heartbeat", None, 2), (1, 3, "log", "Completed 2 / 4", None),
        (1, None, "done", None, 0),
        (2, None, "error", "gone", None), (2, None, "done", None, -1),
    ]


def test_annotated_lines_give_the_same_events(spark, tmp_path):
    rng = random.Random(11)
    texts = ["", " ", "noise", "Completed 3 / 9", "Progress: 40%", "Progress: 7%"]
    rows = [
        (job, seq, seq * 300_000, ["dat-parquet-handler", "retired-tool", "abstec-suite"][job],
         rng.choice(texts))
        for job in range(3) for seq in range(120)
    ]
    df = lines_df(spark, rows)
    path = str(tmp_path / "annotated")
    logs.annotate(df, REGISTRY).write.parquet(path)
    stored = spark.read.parquet(path)
    plain = logs.job_events(df, REGISTRY, idle_seconds=0.5).collect()
    assert sorted(map(str, logs.job_events(stored, REGISTRY, idle_seconds=0.5).collect())) == sorted(map(str, plain))
    plan = logs.idle_beats(stored)._jdf.queryExecution().executedPlan().toString()
    assert "line" not in plan[plan.index("ReadSchema"):]


def test_the_feed_of_a_log_tries_patterns_once(spark):
    from runledger.plans.queries import registered

    events = registered()["job_events"](spark, "/root/testdata/sf0.001")
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp" not in plan and "Relation" in plan


def test_short_tails_are_cut_before_the_shuffle(spark):
    plan = logs.tail_lines(lines_df(spark, [(1, 0, 0, "x", "t")]), 3)._jdf.queryExecution()
    assert plan.executedPlan().toString().count("WindowGroupLimit") == 2


TEXT = b"first\r\n\n \nbad \xff byte\nhalf\rway\nlast"
EXPECTED = ["first", " ", "bad � byte", "half\rway", "last"]


def test_log_text(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.log").write_bytes(TEXT)
    path = str(tmp_path / "in")
    assert [r.line for r in read_log_text(spark, path).orderBy("seq").collect()] == EXPECTED
    query = (
        stream_log_text(spark, path, max_files=1).writeStream.format("memory")
        .queryName("log_text").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(60)
    assert [r.line for r in spark.table("log_text").collect()] == EXPECTED


def test_line_numbers_of_split_and_packed_files(spark, tmp_path):
    """Many small splits, several to a task, and a compressed file next to them."""
    rng = random.Random(3)
    expected = {}
    for name in "abcd":
        lines = [f"{name}{i}" + "x" * rng.randrange(12) for i in range(rng.randrange(20, 90))]
        text = "".join(t + "\n" * rng.choice([1, 1, 4]) for t in lines)
        if name == "d":
            with gzip.open(tmp_path / "d.log.gz", "wt") as out:
                out.write(text)
        else:
            (tmp_path / f"{name}.log").write_text(text)
        expected[name] = lines
    small = {"spark.sql.files.maxPartitionBytes": "61", "spark.sql.files.openCostInBytes": "0"}
    with temporary_conf(spark, small):
        rows = read_log_text(spark, str(tmp_path)).collect()
    for name, lines in expected.items():
        mine = sorted((r.seq, r.line) for r in rows if r.line[0] == name)
        assert mine == list(enumerate(lines))


def test_rotated_files_are_numbered_as_one(spark, tmp_path):
    parts = {"run.log.10": "a b", "run.log.2.gz": "c d e", "run.log.1": "f", "run.log": "g h", "other.log": "x y"}
    for name, text in parts.items():
        with (gzip.open if name.endswith("gz") else open)(tmp_path / name, "wt") as out:
            out.write(text.replace(" ", "\n\n") + "\n")
    rows = read_log_text(spark, str(tmp_path), rotated=True).orderBy("file", "seq").collect()
    assert [(r.file.split("/")[-1], r.seq, r.line) for r in rows] == [
        *(("other.log", k, t) for k, t in enumerate("xy")), *(("run.log", k, t) for k, t in enumerate("abcdefgh"))]


def test_stream_of_new_files_only(spark, tmp_path):
    import os

    (tmp_path / "old.log").write_text("old\n")
    os.utime(tmp_path / "old.log", (1_600_000_000, 1_600_000_000))
    lines = stream_log_text(spark, str(tmp_path), only_new=True)
    (tmp_path / "new.log").write_text("new\n")
    query = lines.writeStream.format("memory").queryName("new_only").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert [r.line for r in spark.table("new_only").collect()] == ["new"]


def test_log_bytes(spark):
    raw = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(TEXT.split(b"\n"))], "seq LONG, raw BINARY")
    assert [r.line for r in lines_from_bytes(raw).orderBy("seq").collect()] == EXPECTED


def test_beats_before_the_end(spark):
    s = 1_000_000
    lines = lines_df(spark, [(1, 0, 0, "tec-suite", "x"), (1, 1, s, "tec-suite", "y"), (2, 0, 0, "tec-suite", "x")])
    after = {job: EPOCH + dt.timedelta(seconds=n) for job, n in ((1, 61), (2, 14), (3, 30), (4, 30))}
    ended = spark.createDataFrame(
        [(1, after[1], EPOCH), (2, after[2], EPOCH), (3, after[3], EPOCH), (4, after[4], None)],
        "job_id LONG, ts TIMESTAMP, started_at TIMESTAMP",
    )
    got = sorted((r.job_id, r.beats) for r in logs.closing_beats(lines, ended).collect())
    assert got == [(1, 4), (3, 2)]


def test_buckets_of_many_runs_are_bounded_together():
    """A bucket that holds a line shown stays, whatever stands beside its run."""
    rng = np.random.default_rng(5)
    first, last, starts, gaps, lines = [], [], [], rng.integers(50, 400, 60), []
    for gap in gaps:
        us = np.unique(rng.integers(0, 5000, rng.integers(1, 300))) + int(rng.integers(-(10**9), 10**9))
        bucket = us // 7
        at = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        starts.append(len(first))
        first += us[at].tolist()
        last += us[np.append(at[1:], len(us)) - 1].tolist()
        lines.append((us, bucket, bucket[at]))
    kept = throttle_module._possible(np.array(first), np.array(last), np.array(starts), gaps, gaps)
    dropped = 0
    for (us, bucket, own), start, gap in zip(lines, starts, gaps):
        shown, allowed = [], None
        for x, b in zip(us, bucket):
            if allowed is None or x >= allowed:
                shown.append(b)
                allowed = x + gap
        marked = kept[start : start + len(own)]
        assert marked[np.isin(own, shown)].all()
        dropped += int((~marked).sum())
    assert dropped
