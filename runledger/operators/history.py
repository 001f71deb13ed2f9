"""Queries over the run history.

Joins carry no broadcast hints: the planner broadcasts a side only when its size
statistics are below ``spark.sql.autoBroadcastJoinThreshold``, and adaptive execution
splits a shuffle join's hot keys otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions import runs as R
from runledger.functions.text import is_yes
from runledger.registry import Registry

# Order of writes that carry the same time.
PRI_START, PRI_STOP, PRI_DONE = 0, 1, 2


def _newest_first() -> list[Column]:
    return [F.col("started_at").desc(), F.col("id").desc()]


def with_flags(runs: DataFrame) -> DataFrame:
    """Adds ``flags``, the decoded form of ``flags_json``."""
    return runs.withColumn("flags", R.decode_flags(F.col("flags_json")))


def with_auto_remove(runs: DataFrame) -> DataFrame:
    """Adds ``auto_remove``: was the run to leave no container behind?"""
    flags = R.decode_flags(F.col("flags_json"))
    return runs.withColumn("auto_remove", is_yes(F.try_element_at(flags, F.lit("auto_remove"))))


def with_names(runs: DataFrame, users: DataFrame, registry: Registry) -> DataFrame:
    """Adds ``username``, ``label`` and ``duration_seconds``. Runs of unknown users stay."""
    names = users.select(F.col("id").alias("user_id"), "username")
    return (
        runs.join(names, "user_id", "left")
        .withColumn("label", registry.label_of(F.col("converter")))
        .withColumn(
            "duration_seconds", R.duration_seconds(F.col("started_at"), F.col("finished_at"))
        )
    )


def with_outcome(
    runs: DataFrame, seen: Column, looked_up: Column, launch_failed: Column, stopped: Column
) -> DataFrame:
    """Adds ``status`` and ``exit_code`` of ended runs from what is known about their end."""
    code = R.resolve_exit_code(seen, looked_up)
    result = R.outcome(code, launch_failed, stopped)
    return runs.withColumn("status", result["status"]).withColumn("exit_code", result["exit_code"])


def runs_of_active_users(runs: DataFrame, users: DataFrame) -> DataFrame:
    """Runs whose user exists and is active."""
    active = users.where("is_active").select(F.col("id").alias("user_id"))
    return runs.join(active, "user_id", "left_semi")


def visible_to(runs: DataFrame, viewer_id: int, is_admin: bool) -> DataFrame:
    """What one viewer may see: an admin everything, others their own runs."""
    return runs if is_admin else runs.where(F.col("user_id") == viewer_id)


def visibility_grants(runs: DataFrame, users: DataFrame) -> DataFrame:
    """Who may see which run, for all viewers at once.

    One grant to the role ``admin`` per run, and one to the owner unless they are an admin
    already. Expanding the admin grant to each admin would multiply the history by the
    number of admins, so the role stands for them.
    """
    roles = users.select(F.col("id").alias("user_id"), (F.col("role") == "admin").alias("is_admin"))
    owned = runs.select("id", "user_id").join(roles, "user_id", "left")
    to_admins = F.struct(F.lit("role").alias("grant"), F.lit(None).cast("bigint").alias("viewer_id"))
    to_owner = F.struct(F.lit("owner").alias("grant"), F.col("user_id").alias("viewer_id"))
    grants = F.when(F.col("is_admin"), F.array(to_admins)).otherwise(F.array(to_admins, to_owner))
    return owned.select(F.col("id").alias("run_id"), F.inline(grants))


def _has_container() -> Column:
    """Does a run have a container? An empty id is none."""
    return F.coalesce(F.col("container_id") != "", F.lit(False))


def check_access(
    requests: DataFrame, runs: DataFrame, users: DataFrame, to_follow: bool = False
) -> DataFrame:
    """Adds ``decision`` to ``(viewer_id, run_id)`` requests.

    ``no_session`` for unknown or inactive viewers, ``not_found`` for unknown runs, then
    ``allowed`` for admins and owners and ``denied`` for the rest. Requests ``to_follow`` a
    run's log are ``no_container`` instead of allowed where the run has none.
    """
    attached = _has_container() if to_follow else F.lit(True)
    owners = runs.select(
        F.col("id").alias("run_id"), F.col("user_id").alias("owner_id"), attached.alias("_attached")
    )
    viewers = users.where("is_active").select(
        F.col("id").alias("viewer_id"), (F.col("role") == "admin").alias("is_admin")
    )
    decision = (
        F.when(F.col("is_admin").isNull(), "no_session")
        .when(F.col("owner_id").isNull(), "not_found")
        .when(~(F.col("is_admin") | (F.col("owner_id") == F.col("viewer_id"))), "denied")
        .when(~F.col("_attached"), "no_container")
        .otherwise("allowed")
    )
    return (
        requests.join(owners, "run_id", "left")
        .join(viewers, "viewer_id", "left")
        .withColumn("decision", decision)
        .drop("owner_id", "is_admin", "_attached")
    )


def history_page(
    runs: DataFrame,
    users: DataFrame,
    registry: Registry,
    viewer_id: int,
    is_admin: bool,
    page: int = 1,
    per_page: int = 25,
) -> DataFrame:
    """One page of the viewer's history, newest first.

    The page is cut before names are joined to it. A page costs its offset in rows, so walk
    far into a history with ``history_after`` instead.
    """
    if per_page < 1:
        raise ValueError("per_page must be positive")
    rows = (
        visible_to(runs, viewer_id, is_admin)
        .orderBy(*_newest_first())
        .offset(max(0, (page - 1) * per_page))
        .limit(per_page)
    )
    return with_names(rows, users, registry).orderBy(*_newest_first())


# Widths of the blocks that runs are counted by, of start times in microseconds and then of ids.
_TIME_BLOCKS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)
_ID_BLOCKS = (1 << 40, 1 << 30, 1 << 20, 1 << 10)


def _block_of(rows: DataFrame, offset: int, near: int) -> tuple[Column, int] | None:
    """A condition for all rows from a block on, and how many of them come before ``offset``: fewer than ``near``,
    or a block of the last width. None where the rows end before it.

    Each round counts rows per block within the block found before, newest first; no round returns
    more counts than blocks fit into one of the round before, the first one as many as there are days.
    """
    time, before, within, start = R.micros(F.col("started_at")), 0, F.lit(True), 0
    moment = rows.schema["started_at"].dataType
    rounds = [(time, w, True) for w in _TIME_BLOCKS] + [(F.col("id"), w, False) for w in _ID_BLOCKS]
    for key, width, is_time in rounds:
        counts = (
            rows.where(within).groupBy((key - F.pmod(key, F.lit(width))).alias("start")).count()
            .orderBy(F.col("start").desc()).collect()
        )
        for block, count in counts:
            if before + count > offset:
                break
            before += count
        else:
            return None
        if is_time:
            start = block
            # Said of the column itself as well, so that it reaches the file scan.
            until, since = (F.timestamp_micros(F.lit(us)).cast(moment) for us in (start + width, start))
            rest = F.col("started_at") < until
            within = rest & (F.col("started_at") >= since)
        else:
            at = F.timestamp_micros(F.lit(start)).cast(moment)
            same = F.col("started_at") == at
            rest = (F.col("started_at") <= at) & ((F.col("started_at") < at) | (F.col("id") < block + width))
            within = same & (F.col("id") < block + width) & (F.col("id") >= block)
        if count <= near:
            break
    return rest, offset - before


def history_deep_page(
    runs: DataFrame,
    users: DataFrame,
    registry: Registry,
    viewer_id: int,
    is_admin: bool,
    page: int = 1,
    per_page: int = 25,
    near: int = 10_000,
) -> DataFrame:
    """The same page as ``history_page``, however deep it lies.

    Counts per block of start times say where the page begins; then only rows from that block on are
    ranked, and a task sends the page and what stands before it in the block: at most ``near`` rows, or 1,024 where more
    runs start at one instant. Runs have a start time. A page behind the last one is empty.
    """
    if per_page < 1:
        raise ValueError("per_page must be positive")
    seen = visible_to(runs, viewer_id, is_admin)
    found = _block_of(seen, max(0, (page - 1) * per_page), near)
    rows = seen.limit(0) if found is None else (
        seen.where(found[0]).orderBy(*_newest_first()).offset(found[1]).limit(per_page)
    )
    return with_names(rows, users, registry).orderBy(*_newest_first())


def history_after(
    runs: DataFrame,
    users: DataFrame,
    registry: Registry,
    viewer_id: int,
    is_admin: bool,
    started_at: Column,
    run_id: int,
    per_page: int = 25,
) -> DataFrame:
    """The page that follows a given run; costs one page however deep it lies."""
    if per_page < 1:
        raise ValueError("per_page must be positive")
    older = (F.col("started_at") < started_at) | (
        (F.col("started_at") == started_at) & (F.col("id") < run_id)
    )
    # Implied by the condition above, and simple enough to reach the file scan.
    within = F.col("started_at") <= started_at
    rows = (
        visible_to(runs, viewer_id, is_admin)
        .where(within & older)
        .orderBy(*_newest_first())
        .limit(per_page)
    )
    return with_names(rows, users, registry).orderBy(*_newest_first())


def history_totals(runs: DataFrame, users: DataFrame, per_page: int = 25) -> DataFrame:
    """Visible runs and pages for every user."""
    if per_page < 1:
        raise ValueError("per_page must be positive")
    own = runs.groupBy("user_id").agg(F.count("*").alias("own"))
    everything = runs.agg(F.count("*")).scalar()
    total = F.when(F.col("role") == "admin", everything).otherwise(
        F.coalesce(F.col("own"), F.lit(0))
    )
    return (
        users.select(F.col("id").alias("user_id"), "role")
        .join(own, "user_id", "left")
        .select("user_id", total.cast("bigint").alias("total"))
        .withColumn(
            "total_pages",
            F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(per_page))).cast("bigint"),
        )
    )


def most_recent(runs: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The newest ``count`` runs per key, ranked.

    Each task keeps only its own best rows per key before the shuffle, so a hot key
    arrives as ``count`` rows per task.
    """
    newest = Window.partitionBy(*keys).orderBy(*_newest_first())
    return runs.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= count)


def recent_per_user(runs: DataFrame, count: int = 5) -> DataFrame:
    return most_recent(runs, ["user_id"], count)


def recent_per_user_converter(runs: DataFrame, count: int = 3) -> DataFrame:
    return most_recent(runs, ["user_id", "converter"], count)


def start_writes(runs: DataFrame) -> DataFrame:
    """The first write to a run's state: it is running."""
    return runs.select(
        F.col("id").alias("run_id"), F.col("started_at").cast("timestamp").alias("changed_at"),
        F.lit(PRI_START).alias("pri"), F.lit("running").alias("status"),
        F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("int").alias("exit_code"),
    )


def end_writes(ended: DataFrame, pri: int = PRI_DONE) -> DataFrame:
    """The write that ends a run; needs ``run_id, finished_at, status, exit_code``."""
    moment = F.col("finished_at").cast("timestamp")
    return ended.select(
        "run_id", moment.alias("changed_at"), F.lit(pri).alias("pri"), "status",
        moment.alias("finished_at"), F.col("exit_code").cast("int").alias("exit_code"),
    )


def launch_failure_writes(failures: DataFrame) -> DataFrame:
    """The writes of launches that failed, ``(run_id, ts)``: an error without a known exit code."""
    return end_writes(failures.select(
        "run_id", F.col("ts").alias("finished_at"), F.lit("error").alias("status"),
        F.lit(R.UNKNOWN_EXIT).alias("exit_code"),
    ))


def stop_writes(decided: DataFrame, state: DataFrame, runs: DataFrame) -> DataFrame:
    """Writes for requests to stop a run: ``decided`` comes from ``check_access`` with ``ts``.

    Only allowed requests on runs that have a container and are still running write
    anything, the first one per run.
    """
    asked = (
        decided.where(F.col("decision") == "allowed")
        .groupBy("run_id").agg(F.min("ts").alias("finished_at"))
    )
    running = state.where(F.col("status") == "running").select("run_id")
    attached = runs.where(_has_container()).select(F.col("id").alias("run_id"))
    stoppable = running.join(attached, "run_id", "left_semi")
    stopped = asked.join(stoppable, "run_id", "left_semi").select(
        "run_id", "finished_at", F.lit("failed").alias("status"),
        F.lit(R.STOPPED_EXIT).alias("exit_code"),
    )
    return end_writes(stopped, PRI_STOP)


def current_state(writes: DataFrame, policy: str = "last_writer") -> DataFrame:
    """State of each run after all writes to it.

    ``last_writer`` lets a late write replace an outcome, also a stop by its real exit
    code. ``first_terminal`` keeps the first outcome. Repeated writes change nothing, so
    the writes may be delivered more than once.
    """
    order = F.struct("changed_at", "pri", F.coalesce(F.col("exit_code"), F.lit(-(2**31))), "status")
    state = F.struct("status", "finished_at", "exit_code")
    latest = F.max_by(state, order)
    if policy == "first_terminal":
        ended = F.col("status") != "running"
        latest = F.coalesce(
            F.min_by(F.when(ended, state), F.when(ended, order)), latest
        )
    elif policy != "last_writer":
        raise ValueError(f"unknown policy: {policy}")
    return writes.groupBy("run_id").agg(latest.alias("state")).select("run_id", "state.*")
