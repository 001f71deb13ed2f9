"""The registered queries: each operator over whole bridge views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import default_registry, schemas
from runledger.functions.runs import UNKNOWN_EXIT, micros
from runledger.operators import (
    commands, convert, history, inventory, logs, requests, samples, throttle,
)
from runledger.operators.state import Snapshots
from runledger.plans.bridge import SITES, stream, view
from runledger.session import scratch_path, ship_package, use_utc
from runledger.sources import archive, dat, tables
from runledger.sources import logs as log_source
from runledger.streaming import batches, outcomes

REGISTRY = default_registry()

# Viewers whose pages are shown, and the throttle of the sparse bridge log.
ADMIN_ID, OPERATOR_ID = 0, 1
THROTTLE_SEC = 6 * 3600.0
DEEP_PAGE = 40


def _rounded(name: str) -> Column:
    return F.round(name, 6).alias(name)


def _joined(name: str, separator: str = ",") -> Column:
    return F.array_join(name, separator).alias(name)


def _history(viewer_id: int, is_admin: bool, page: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = history.history_page(
            view("job_runs", spark, sf), view("users", spark, sf), REGISTRY,
            viewer_id, is_admin, page,
        )
        return rows.select(
            "id", "user_id", "username", "label", "started_at", _rounded("duration_seconds")
        )

    return query


def history_after(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.history_after(
        view("job_runs", spark, sf), view("users", spark, sf), REGISTRY, ADMIN_ID, True,
        F.to_timestamp_ntz(F.lit("1998-06-15 00:00:00")), 500,
    )
    return rows.select("id", "user_id", "username", "label", "started_at")


def history_deep_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page far back in the history; the first block of runs that hold it is found by counts."""
    rows = history.history_deep_page(
        view("job_runs", spark, sf), view("users", spark, sf), REGISTRY, ADMIN_ID, True, DEEP_PAGE, near=100
    )
    return rows.select("id", "user_id", "username", "label", "started_at")


def history_totals(spark: SparkSession, sf: str) -> DataFrame:
    return history.history_totals(view("job_runs", spark, sf), view("users", spark, sf))


def run_visibility(spark: SparkSession, sf: str) -> DataFrame:
    return history.visibility_grants(view("job_runs", spark, sf), view("users", spark, sf))


def run_access(spark: SparkSession, sf: str) -> DataFrame:
    return history.check_access(
        view("access_requests", spark, sf), view("job_runs", spark, sf), view("users", spark, sf)
    ).select("viewer_id", "run_id", "line", "decision")


def follow_access(spark: SparkSession, sf: str) -> DataFrame:
    """Who may follow which run's log; runs without a container have none."""
    return history.check_access(
        view("access_requests", spark, sf), view("job_runs", spark, sf), view("users", spark, sf),
        to_follow=True,
    ).select("viewer_id", "run_id", "line", "decision")


def runs_of_active_users(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.runs_of_active_users(view("job_runs", spark, sf), view("users", spark, sf))
    return rows.select("id", "user_id", "converter")


def run_enriched(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.with_names(view("job_runs", spark, sf), view("users", spark, sf), REGISTRY)
    return rows.select("id", "username", "label", _rounded("duration_seconds"))


def run_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.with_flags(view("job_runs", spark, sf))
    return rows.select(
        "id",
        F.size("flags").alias("n_flags"),
        F.try_element_at("flags", F.lit("jobs")).alias("jobs"),
        F.try_element_at("flags", F.lit("auto_remove")).alias("auto_remove"),
    )


def run_auto_remove(spark: SparkSession, sf: str) -> DataFrame:
    return history.with_auto_remove(view("job_runs", spark, sf)).select("id", "auto_remove")


def run_outcome(spark: SparkSession, sf: str) -> DataFrame:
    ended = view("job_runs", spark, sf).where(F.col("finished_at").isNotNull())
    # Some codes were seen on the stream, some looked up later, some never found.
    seen = F.when(F.col("id") % 5 > 1, F.col("exit_code"))
    looked_up = F.when(F.col("id") % 5 == 1, F.col("exit_code"))
    rows = history.with_outcome(
        ended, seen, looked_up,
        launch_failed=(F.col("exit_code") == -1) & (F.col("id") % 2 == 0),
        stopped=F.col("exit_code") == -2,
    )
    return rows.select("id", "status", "exit_code")


def state_writes(runs: DataFrame) -> DataFrame:
    """Writes to the state of the bridge runs: all start, some are stopped, many end."""
    started = F.col("started_at").cast("timestamp")
    finished = F.col("finished_at").cast("timestamp")
    stopped = started + F.expr("INTERVAL 10 MINUTES")

    def write(at: Column, pri: int, status: str | Column, end: Column, code: Column) -> Column:
        return F.struct(
            at.alias("changed_at"), F.lit(pri).alias("pri"),
            (F.lit(status) if isinstance(status, str) else status).alias("status"),
            end.cast("timestamp").alias("finished_at"), code.cast("int").alias("exit_code"),
        )

    nothing = F.lit(None)
    start = write(started, history.PRI_START, "running", nothing, nothing)
    stop = write(stopped, history.PRI_STOP, "failed", stopped, F.lit(-2))
    outcome = F.when(F.col("exit_code") == 0, "success").otherwise("failed")
    done = write(finished, history.PRI_DONE, outcome, finished, F.col("exit_code"))
    was_stopped, has_ended = F.col("id") % 7 == 0, finished.isNotNull()
    writes = (
        F.when(was_stopped & has_ended, F.array(start, stop, done))
        .when(was_stopped, F.array(start, stop))
        .when(has_ended, F.array(start, done))
        .otherwise(F.array(start))
    )
    return runs.select(F.col("id").alias("run_id"), F.inline(writes))


def _run_state(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = history.current_state(state_writes(view("job_runs", spark, sf)), policy)
        return rows.withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz"))

    return query


def run_state_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """State of all runs from a snapshot and the writes since: those that end runs arrive later, in two parts."""
    writes = state_writes(view("job_runs", spark, sf))
    path = scratch_path(spark, "writes")
    snapshots = Snapshots(scratch_path(spark, "snapshots"), path, buckets=8)
    started = F.col("status") == "running"
    for part in (started, ~started & (F.col("run_id") % 2 == 0), ~started & (F.col("run_id") % 2 != 0)):
        tables.append_state(writes.where(part), path)
        snapshots.refresh(spark)
    return snapshots.state(spark).withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz"))


def recent_per_user(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.recent_per_user(view("job_runs", spark, sf))
    return rows.select("user_id", F.col("rank").cast("bigint").alias("rank"), "id")


def recent_per_user_converter(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.recent_per_user_converter(view("job_runs", spark, sf))
    return rows.select("user_id", "converter", F.col("rank").cast("bigint").alias("rank"), "id")


def _tail(count: str | int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return logs.tail_lines(view("job_log_lines", spark, sf), count).select(
            "job_id", "seq", "line"
        )

    return query


def log_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs.matching_lines(view("job_log_lines", spark, sf), REGISTRY)
    return rows.select("job_id", "seq", "line")


def log_progress(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs.with_progress(view("job_log_lines", spark, sf), REGISTRY)
    return rows.select("job_id", "seq", "progress")


def progress_monotonic(spark: SparkSession, sf: str) -> DataFrame:
    return logs.monotonic_progress(view("job_log_lines", spark, sf), REGISTRY)


def idle_beats(spark: SparkSession, sf: str) -> DataFrame:
    return logs.idle_beats(view("job_log_lines", spark, sf))


def _throttled(interval_sec: float | None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        lines = logs.matching_lines(view("job_log_lines", spark, sf), REGISTRY)
        rows = throttle.throttle(lines, REGISTRY, interval_sec)
        return rows.select("job_id", "seq", "ts", "line")

    return query


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    """The log with its patterns tried once per line; each step of a feed reads its few columns from there."""
    path = scratch_path(spark, "marked")
    logs.annotate(view("job_log_lines", spark, sf), REGISTRY).write.parquet(path)
    return spark.read.parquet(path)


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    runs = view("job_runs", spark, sf).where(F.col("finished_at").isNotNull())
    lost = F.col("exit_code") == UNKNOWN_EXIT
    ended = runs.select(
        F.col("id").alias("job_id"), F.col("finished_at").alias("ts"), "exit_code", "started_at",
        F.when(lost, "container not found").alias("error"),
    )
    return logs.job_events(
        _marked(spark, sf), REGISTRY, ended, interval_sec=THROTTLE_SEC,
        started=_starts(spark, sf),
    )


def _starts(spark: SparkSession, sf: str) -> DataFrame:
    return view("job_runs", spark, sf).select(F.col("id").alias("job_id"), "started_at")


def idle_beats_from_start(spark: SparkSession, sf: str) -> DataFrame:
    """Idle periods before each line, also before a run's first one, counted from the run's start."""
    started = _starts(spark, sf).select("job_id", micros(F.col("started_at")).alias("last_us"))
    return logs.idle_beats(view("job_log_lines", spark, sf), seeds=started)


def feed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The feed as a stream over the log table, run to its end and read back."""
    out = batches.Feed(scratch_path(spark, "feed"))
    batches.follow_batches(
        stream("job_log_lines", spark, sf), REGISTRY, out, scratch_path(spark, "checkpoint"),
        interval_sec=THROTTLE_SEC, started=lambda: _starts(spark, sf),
    ).awaitTermination()
    return out.events(spark).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def outcome_stream(spark: SparkSession, sf: str) -> DataFrame:
    """State of all runs after a stream of exit notices has been recorded."""
    ended = stream("job_runs", spark, sf).where(F.col("finished_at").isNotNull())
    exits = ended.select(
        F.col("id").alias("run_id"), F.col("finished_at").cast("timestamp").alias("ts"),
        F.when(F.col("id") % 5 > 1, F.col("exit_code")).alias("stream_code"),
        F.when(F.col("id") % 5 == 1, F.col("exit_code")).alias("looked_up_code"),
    )
    state = scratch_path(spark, "state")
    tables.append_state(history.start_writes(view("job_runs", spark, sf)), state)
    outcomes.record_outcomes(exits, state, scratch_path(spark, "checkpoint")).awaitTermination()
    rows = history.current_state(tables.read_state_writes(spark, state))
    return rows.withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz"))


def run_stops(spark: SparkSession, sf: str) -> DataFrame:
    """What users' requests to stop their runs write to the state."""
    asked = view("access_requests", spark, sf).withColumn(
        "ts", F.to_timestamp(F.lit("2001-01-01 00:00:00"))
    )
    runs, users = view("job_runs", spark, sf), view("users", spark, sf)
    state = history.current_state(state_writes(runs))
    rows = history.stop_writes(history.check_access(asked, runs, users), state, runs)
    return rows.select("run_id", "status", "exit_code")


def archive_days(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.archive_days(view("file_manifest", spark, sf))


def archive_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = inventory.archive_tree(view("file_manifest", spark, sf))
    shown = F.transform("days", lambda d: F.concat_ws(":", d["day"], d["stations"]))
    return rows.select("year", F.array_join(shown, ",").alias("days"))


def _archive_requests(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("path", "/")
    last = F.expr("right(path, 5)")
    converter = (
        F.when(last == "9.zip", "retired-tool").when(last == "8.zip", "dat-parquet-handler")
        .otherwise("tec-suite")
    )
    form = F.create_map(
        F.lit("root"), F.when(F.expr("endswith(path, '.txt')"), " ").otherwise("/mnt/rinex"),
        F.lit("root_subpath"), F.concat(F.lit(" /"), F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1))),
        F.lit("jobs"), F.when(last == "7.zip", "many").otherwise("4"),
    )
    return view("file_manifest", spark, sf).select(
        "path", converter.alias("converter"), form.alias("form")
    )


def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = requests.validate(_archive_requests(spark, sf), REGISTRY)
    return rows.select("path", "converter", "reject_reason")


def effective_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = commands.effective_flags(view("run_forms", spark, sf), REGISTRY)
    return rows.select("id", "ordinal", "flag", "value", "emitted", "bad", _joined("args", " "))


def run_commands(spark: SparkSession, sf: str) -> DataFrame:
    rows = commands.run_commands(view("run_forms", spark, sf), REGISTRY)
    return rows.select("id", _joined("command", " "))


def day_list(spark: SparkSession, sf: str) -> DataFrame:
    return samples.day_list(view("day_requests", spark, sf)).select("id", "doy")


def _selected(station: str, match: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = samples.select_samples(
            view("tec_samples", spark, sf), year=2024, doy=[3, 10, 17], station=station, match=match
        )
        return rows.select("site", "doy", "ts", "sat", _rounded("el"), _rounded("tec"))

    return query


def elevation_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples.above_cutoff(view("tec_samples", spark, sf))
    return rows.select("site", "ts", "sat", _rounded("el"))


def time_bins(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples.time_bins(samples.above_cutoff(view("tec_samples", spark, sf)))
    return rows.select("site", "sat", "bin_start", _rounded("tec"), "samples")


def pivot_export(spark: SparkSession, sf: str) -> DataFrame:
    table = samples.pivot_by_site(view("tec_samples", spark, sf), SITES)
    path = scratch_path(spark, "pivot")
    dat.export_csv(table.select("year", "doy", *[_rounded(s) for s in SITES]), path)
    ddl = "year INT, doy INT, " + ", ".join(f"{s} DOUBLE" for s in SITES)
    return spark.read.schema(ddl).option("header", "true").csv(path)


def _stored_as_text(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "dat")
    dat.write_dat(view("tec_samples", spark, sf), path, schemas.SAMPLES)
    return path


_SAMPLE_COLUMNS = ["site", "year", "doy", "ts", "sat", "el", "tec"]


def dat_to_parquet(spark: SparkSession, sf: str) -> DataFrame:
    src, dst = _stored_as_text(spark, sf), scratch_path(spark, "samples")
    convert.dat_to_parquet(spark, src, dst, schemas.SAMPLES)
    return dat.read_samples(spark, dst).select(_SAMPLE_COLUMNS)


def dat_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    src, dst = scratch_path(spark, "samples"), scratch_path(spark, "dat")
    dat.write_samples(view("tec_samples", spark, sf), src)
    convert.parquet_to_dat(spark, src, dst, schemas.SAMPLES)
    return dat.read_dat(spark, dst, schemas.SAMPLES).select(_SAMPLE_COLUMNS)


def convert_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Text samples that arrive in two parts, converted three times; the last time there is nothing to do."""
    src, dst = scratch_path(spark, "dat"), scratch_path(spark, "samples")
    rows = view("tec_samples", spark, sf)
    for part in ("doy % 3 = 0", "doy % 3 <> 0"):
        dat.write_dat(rows.where(part), src, schemas.SAMPLES)
        convert.dat_to_parquet(spark, src, dst, schemas.SAMPLES)
    convert.dat_to_parquet(spark, src, dst, schemas.SAMPLES)
    return dat.read_samples(spark, dst).select(_SAMPLE_COLUMNS)


def convert_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    """Text samples converted twice, the second time in place of the first."""
    src, dst = _stored_as_text(spark, sf), scratch_path(spark, "samples")
    for again in (False, True):
        convert.dat_to_parquet(spark, src, dst, schemas.SAMPLES, overwrite=again)
    return dat.read_samples(spark, dst).select(_SAMPLE_COLUMNS)


def archive_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Folders and files of a stored table of days, as the scan of an archive sees them."""
    root = scratch_path(spark, "archive")
    days = view("tec_samples", spark, sf).select("year", "doy", "site").distinct()
    days.repartition("year", "doy").write.partitionBy("year", "doy").csv(root)
    named = F.when(F.col("is_dir"), F.col("path")).otherwise(F.regexp_replace("path", "/part-[^/]+$", "/file"))
    return archive.scan_archive(spark, root).where("NOT startswith(path, '_') AND NOT startswith(path, '.')").select(
        named.alias("path"), "is_dir"
    ).where("NOT path LIKE '%.crc'")


def log_text(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered lines of text files that hold the log of several runs each."""
    root = scratch_path(spark, "logs")
    lines = view("job_log_lines", spark, sf).withColumn("part", F.pmod("job_id", F.lit(16)))
    (
        lines.repartition("part").sortWithinPartitions("part", "job_id", "seq")
        .select("part", "line").write.partitionBy("part").text(root)
    )
    part = F.regexp_extract("file", "/part=([0-9]+)/", 1).cast("bigint")
    return log_source.read_log_text(spark, root).select(part.alias("part"), "seq", "line")


def convert_pending(spark: SparkSession, sf: str) -> DataFrame:
    manifest = view("file_manifest", spark, sf)
    done = manifest.where("path LIKE '%1.zip' OR path LIKE '%/0%'")
    return convert.pending(manifest, done, ["path"]).select("path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "history_page": _history(ADMIN_ID, True, 2),
    "history_page_own": _history(OPERATOR_ID, False, 1),
    "history_after": history_after,
    "history_deep_page": history_deep_page,
    "history_totals": history_totals,
    "run_visibility": run_visibility,
    "run_access": run_access,
    "follow_access": follow_access,
    "runs_of_active_users": runs_of_active_users,
    "run_enriched": run_enriched,
    "run_flags": run_flags,
    "run_auto_remove": run_auto_remove,
    "run_outcome": run_outcome,
    "run_state": _run_state("last_writer"),
    "run_state_first_terminal": _run_state("first_terminal"),
    "run_state_incremental": run_state_incremental,
    "recent_per_user": recent_per_user,
    "recent_per_user_converter": recent_per_user_converter,
    "log_tail": _tail(5),
    "log_tail_long": _tail(1500),
    "log_filter": log_filter,
    "log_progress": log_progress,
    "progress_monotonic": progress_monotonic,
    "idle_beats": idle_beats,
    "idle_beats_from_start": idle_beats_from_start,
    "log_throttle": _throttled(THROTTLE_SEC),
    "log_throttle_own_interval": _throttled(None),
    "job_events": job_events,
    "feed_stream": feed_stream,
    "outcome_stream": outcome_stream,
    "run_stops": run_stops,
    "archive_days": archive_days,
    "archive_tree": archive_tree,
    "request_validation": request_validation,
    "effective_flags": effective_flags,
    "run_commands": run_commands,
    "day_list": day_list,
    "sample_select": _selected("site7", "exact"),
    "sample_select_prefix": _selected("site1", "prefix"),
    "elevation_cutoff": elevation_cutoff,
    "time_bins": time_bins,
    "pivot_export": pivot_export,
    "dat_to_parquet": dat_to_parquet,
    "dat_roundtrip": dat_roundtrip,
    "convert_pending": convert_pending,
    "convert_incremental": convert_incremental,
    "convert_overwrite": convert_overwrite,
    "archive_scan": archive_scan,
    "log_text": log_text,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries, ready for a session somebody else has set up."""
    def prepared(query: Callable[[SparkSession, str], DataFrame]):
        return lambda spark, sf_dir: query(ship_package(use_utc(spark)), sf_dir.rstrip("/"))

    return {name: prepared(query) for name, query in QUERIES.items()}
