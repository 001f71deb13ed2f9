import datetime as dt

import pytest
from pyspark.sql import functions as F

from runledger import default_registry
from runledger.operators import history
from runledger.sources import tables

REGISTRY = default_registry()
T0 = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(
        [(1, "ada", "admin", True), (2, "oleg", "operator", True),
         (3, "gone", "operator", False), (4, "idle", "operator", True)],
        "id LONG, username STRING, role STRING, is_active BOOLEAN",
    )


@pytest.fixture(scope="module")
def runs(spark):
    """Forty runs of the operator, three at a time, one of the admin, one of an unknown user."""
    starts = [T0 + dt.timedelta(hours=i // 3) for i in range(40)]
    rows = [
        (i, 2, "tec-suite", '{"jobs": %d}' % i, start, start + dt.timedelta(seconds=40 + i), 0)
        for i, start in enumerate(starts)
    ]
    rows += [(40, 1, "retired-tool", "{}", T0, None, None), (41, 9, "abstec-suite", None, T0, None, None)]
    return spark.createDataFrame(
        rows, "id LONG, user_id LONG, converter STRING, flags_json STRING,"
        " started_at TIMESTAMP, finished_at TIMESTAMP, exit_code INT",
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_pages(runs, users):
    def page(viewer, admin, n, per_page=25):
        return ids(history.history_page(runs, users, REGISTRY, viewer, admin, n, per_page))

    assert page(2, False, 1) == list(range(39, 14, -1))
    assert page(2, False, 2) == list(range(14, -1, -1))
    assert page(2, False, 3) == []
    assert page(2, False, 0) == page(2, False, 1)
    assert page(4, False, 1) == []
    everything = page(1, True, 1) + page(1, True, 2)
    assert sorted(everything) == list(range(42)) and len(everything) == 42
    with pytest.raises(ValueError):
        page(1, True, 1, 0)


def test_deep_pages_equal_the_sorted_history(spark, users):
    """Spread starts, and thousands of runs that start at one instant. The rows of a page, not their order: see README."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, 1 + i % 2, "tec-suite", start + dt.timedelta(seconds=37 * (i % 900))) for i in range(900)]
    rows += [(i, 1, "tec-suite", start + dt.timedelta(hours=5)) for i in range(2000, 6000)]
    many = spark.createDataFrame(rows, "id LONG, user_id LONG, converter STRING, started_at TIMESTAMP").withColumn(
        "finished_at", F.lit(None).cast("timestamp")).persist()
    order = [r[0] for r in sorted(rows, key=lambda r: (r[3], r[0]), reverse=True)]
    for page, near in ((1, 50), (3, 50), (61, 50), (160, 50), (193, 20), (196, 50), (197, 50), (5000, 50), (150, 10_000)):
        got = {r.id for r in history.history_deep_page(many, users, REGISTRY, 1, True, page, 25, near).collect()}
        assert got == set(order[(page - 1) * 25 : page * 25])
    own = {r.id for r in history.history_deep_page(many, users, REGISTRY, 1, False, 170, 25, 30).collect()}
    assert own == set([i for i in order if i >= 2000 or i % 2 == 0][169 * 25 : 170 * 25])
    rest, skipped = history._block_of(many, 3000, 50)
    assert skipped < 1024
    many.unpersist()


def test_cursor_walks_the_same_pages(runs, users):
    seen, page = [], history.history_page(runs, users, REGISTRY, 1, True, 1, 7).collect()
    while page:
        seen += [r.id for r in page]
        last = page[-1]
        page = history.history_after(
            runs, users, REGISTRY, 1, True, F.lit(last.started_at), last.id, 7
        ).collect()
    assert seen == ids(history.history_page(runs, users, REGISTRY, 1, True, 1, 100))


def test_totals(runs, users):
    got = {r.user_id: (r.total, r.total_pages) for r in history.history_totals(runs, users).collect()}
    assert got == {1: (42, 2), 2: (40, 2), 3: (0, 1), 4: (0, 1)}
    with pytest.raises(ValueError):
        history.history_totals(runs, users, 0)


def test_names_survive_unknown_users_and_converters(runs, users):
    got = {r.id: (r.username, r.label, r.duration_seconds)
           for r in history.with_names(runs, users, REGISTRY).collect()}
    assert len(got) == 42
    assert got[3] == ("oleg", "TEC-Suite", 43.0)
    assert got[40] == ("ada", "retired-tool", None)
    assert got[41] == (None, "AbsTEC Suite", None)


def test_visibility(runs, users):
    got = {tuple(r) for r in history.visibility_grants(runs, users).collect()}
    assert {g for g in got if g[0] == 0} == {(0, "role", None), (0, "owner", 2)}
    assert {g for g in got if g[0] == 40} == {(40, "role", None)}
    own = ids(history.visible_to(runs, 2, False))
    assert sorted(own) == sorted(g[0] for g in got if g[2] == 2)


def test_access(spark, runs, users):
    asked = [(1, 0), (2, 0), (4, 0), (2, 40), (3, 0), (99, 0), (2, 77)]
    requests = spark.createDataFrame(asked, "viewer_id LONG, run_id LONG")
    got = {(r.viewer_id, r.run_id): r.decision
           for r in history.check_access(requests, runs, users).collect()}
    assert got == {
        (1, 0): "allowed", (2, 0): "allowed", (4, 0): "denied", (2, 40): "denied",
        (3, 0): "no_session", (99, 0): "no_session", (2, 77): "not_found",
    }


def test_recent(runs):
    got = history.recent_per_user(runs).where("user_id = 2").orderBy("rank")
    assert ids(got) == [39, 38, 37, 36, 35]
    assert history.recent_per_user_converter(runs).where("user_id = 2").count() == 3


def test_hot_key_is_cut_before_the_shuffle(runs):
    plan = history.recent_per_user(runs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_state_policies(spark):
    h = dt.timedelta(hours=1)
    writes = [
        (1, T0, 0, "running", None, None),
        (1, T0 + h, 1, "failed", T0 + h, -2),      # stopped ...
        (1, T0 + 2 * h, 2, "success", T0 + 2 * h, 0),  # ... but it had ended well
        (2, T0, 0, "running", None, None),
        (3, T0, 0, "running", None, None),
        (3, T0, 2, "failed", T0, -1),              # same time: the end comes later
        (4, T0, 0, "running", None, None),
        (4, T0 + h, 2, "success", T0 + h, 0),
        (4, T0 + 2 * h, 2, "failed", T0 + 2 * h, -1),  # stream opened again
    ]
    df = spark.createDataFrame(
        writes + writes[:4],
        "run_id LONG, changed_at TIMESTAMP, pri INT, status STRING, finished_at TIMESTAMP, exit_code INT",
    )

    def state(policy):
        return {r.run_id: (r.status, r.exit_code) for r in history.current_state(df, policy).collect()}

    assert state("last_writer") == {
        1: ("success", 0), 2: ("running", None), 3: ("failed", -1), 4: ("failed", -1)}
    assert state("first_terminal") == {
        1: ("failed", -2), 2: ("running", None), 3: ("failed", -1), 4: ("success", 0)}
    with pytest.raises(ValueError):
        history.current_state(df, "newest")


def test_stops(spark, runs, users):
    asked = spark.createDataFrame(
        [(1, 40, T0), (2, 40, T0), (1, 0, T0), (1, 41, T0 + dt.timedelta(hours=2)),
         (1, 41, T0 + dt.timedelta(hours=1))],
        "viewer_id LONG, run_id LONG, ts TIMESTAMP",
    )
    writes = history.start_writes(runs).unionByName(
        history.end_writes(runs.where("exit_code = 0").selectExpr(
            "id AS run_id", "finished_at", "'success' AS status", "exit_code"))
    )
    state = history.current_state(writes)
    attached = runs.withColumn("container_id", F.lit("c1"))
    decided = history.check_access(asked, runs, users)
    stops = history.stop_writes(decided, state, attached)
    got = {r.run_id: (r.status, r.exit_code, r.finished_at) for r in stops.collect()}
    assert got == {40: ("failed", -2, T0), 41: ("failed", -2, T0 + dt.timedelta(hours=1))}
    after = history.current_state(writes.unionByName(stops)).where("run_id IN (0, 40)")
    assert {r.run_id: r.status for r in after.collect()} == {0: "success", 40: "failed"}
    for none in (F.lit(None).cast("string"), F.lit("")):
        assert history.stop_writes(decided, state, runs.withColumn("container_id", none)).isEmpty()


def test_following_needs_a_container(spark, runs, users):
    only_three = runs.withColumn("container_id", F.when(F.col("id") == 3, "c3").when(F.col("id") == 4, ""))
    requests = spark.createDataFrame(
        [(1, 3), (2, 3), (4, 3), (1, 4), (2, 5), (4, 5), (1, 99), (3, 3)], "viewer_id LONG, run_id LONG"
    )
    decided = history.check_access(requests, only_three, users, to_follow=True)
    assert {(r.viewer_id, r.run_id): r.decision for r in decided.collect()} == {
        (1, 3): "allowed", (2, 3): "allowed", (4, 3): "denied", (1, 4): "no_container",
        (2, 5): "no_container", (4, 5): "denied", (1, 99): "not_found", (3, 3): "no_session"}


def test_a_failed_launch_is_an_error(spark, runs):
    failures = spark.createDataFrame([(40, T0)], "run_id LONG, ts TIMESTAMP")
    writes = history.start_writes(runs).unionByName(history.launch_failure_writes(failures))
    state = history.current_state(writes).where("run_id = 40").first()
    assert (state.status, state.exit_code, state.finished_at) == ("error", -1, T0)


def test_new_runs_are_stored_as_running(spark, tmp_path):
    from runledger.operators import requests

    form = {"root": "/mnt/r", "root_subpath": "/2026_original/001", "jobs": "4", "verbose": "on",
            "auto_remove": "YES"}
    asked = spark.createDataFrame(
        [(7, 2, T0, "tec-suite", form)],
        "id LONG, user_id LONG, requested_at TIMESTAMP, converter STRING, form MAP<STRING,STRING>",
    )
    new = requests.new_runs(requests.accepted(requests.validate(asked, REGISTRY)), REGISTRY)
    runs_path, state_path = str(tmp_path / "runs"), str(tmp_path / "state")
    tables.append_runs(new, runs_path, state_path)
    run = tables.read_runs(spark, runs_path).first()
    assert (run.id, run.user_id, run.status, run.rinex_path) == (7, 2, "running", "/mnt/r")
    stored = history.with_flags(tables.read_runs(spark, runs_path)).first().flags
    assert stored == {**form, "verbose": "true", "cleanup": "false", "auto_remove": "true"}
    state = history.current_state(tables.read_state_writes(spark, state_path)).first()
    assert (state.run_id, state.status) == (7, "running")
