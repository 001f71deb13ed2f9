"""The registered queries once more, as SQL over the same tables, to check results.

Written for another engine on purpose and from the rules, not from the operators.
"""

from __future__ import annotations

from runledger.plans.bridge import SITES, with_views
from runledger.plans.queries import ADMIN_ID, DEEP_PAGE, OPERATOR_ID, THROTTLE_SEC

# Labels, log patterns and, below, the flag table of the three converters, stated
# a second time so that the check does not depend on the registry.
_LABEL = """CASE converter WHEN 'tec-suite' THEN 'TEC-Suite' WHEN 'dat-parquet-handler' THEN 'DAT <-> Parquet'
 WHEN 'abstec-suite' THEN 'AbsTEC Suite' ELSE converter END"""
_DURATION = "round((epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0, 6)"
_LINES = "(SELECT * FROM job_log_lines WHERE length(line) > 0)"

_SUITE = [
    r"===\s*processing\s+day\s+folder:\s*([^\s]+)\s*===",
    r"Completed.*?(\d+)\s*/\s*(\d+):\s+([\w.]+)",
]
_DAT = [r"Completed\s+(\d+)\s*/\s*(\d+)", r"Progress:\s*(\d{1,3})\s*%"]
_ABS = [
    r"Processing\s+year=\d{4}\s+day=\d{1,3}\s+site=[^\s]+\s*\((\d+)\s*/\s*(\d+)\)",
    r"Organized station output under day folder:Completed\s+(\d+)\s*/\s*(\d+)",
    r"Progress:\s*(\d{1,3})\s*%",
]


def _group(pattern: str, n: int) -> str:
    return f"TRY_CAST(regexp_extract(line, '{pattern}', {n}, 'i') AS DOUBLE)"


def _fraction(pattern: str) -> str:
    done, total = _group(pattern, 1), _group(pattern, 2)
    return f"CASE WHEN {total} > 0 THEN CAST(least(100, trunc({done} / {total} * 100)) AS INTEGER) END"


def _alone(pattern: str) -> str:
    share = _group(pattern, 1)
    return f"CASE WHEN {share} IS NOT NULL THEN CAST(least(100, greatest(0, {share})) AS INTEGER) END"


def _any(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(line, '{p}', 'i')" for p in patterns) + ")"


_PROGRESS = f"""CASE converter
 WHEN 'tec-suite' THEN coalesce({_alone(_SUITE[0])}, {_fraction(_SUITE[1])})
 WHEN 'dat-parquet-handler' THEN coalesce({_fraction(_DAT[0])}, {_alone(_DAT[1])})
 ELSE coalesce({_fraction(_ABS[0])}, {_fraction(_ABS[1])}, {_alone(_ABS[2])}) END"""
_SHOWN = f"""CASE converter WHEN 'tec-suite' THEN {_any(_SUITE)}
 WHEN 'dat-parquet-handler' THEN {_any(_DAT)} ELSE {_any(_ABS)} END"""

_MONOTONIC = f"""SELECT job_id, seq, ts, progress FROM (
 SELECT *, max(progress) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
 FROM (SELECT job_id, seq, ts, {_PROGRESS} AS progress FROM {_LINES}) WHERE progress IS NOT NULL)
 WHERE best IS NULL OR progress > best"""
_BEATS = f"""SELECT job_id, seq, ts, CAST(pause // 15000000 AS BIGINT) AS beats FROM (
 SELECT job_id, seq, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY seq) AS pause FROM {_LINES})
 WHERE pause >= 15000000"""

# A follower waits from the run's start on, so the first line has a pause too.
_BEATS_FROM_START = f"""SELECT job_id, seq, ts, CAST(pause // 15000000 AS BIGINT) AS beats FROM (
 SELECT job_id, seq, l.ts, epoch_us(l.ts) - coalesce(lag(epoch_us(l.ts)) OVER (PARTITION BY job_id ORDER BY seq),
  epoch_us(CAST(r.started_at AS TIMESTAMP))) AS pause FROM {_LINES} l LEFT JOIN job_runs r ON r.id = l.job_id)
 WHERE pause >= 15000000"""


def _throttled(interval_us: str) -> str:
    """Chain of shown lines: from each one on to the first that is late enough."""
    return f"""WITH RECURSIVE matched AS (
 SELECT job_id, seq, ts, line, epoch_us(ts) AS us, {interval_us} AS gap FROM {_LINES} WHERE {_SHOWN}),
chain AS (
 SELECT job_id, min(seq) AS seq, min(us) AS us FROM matched GROUP BY job_id
 UNION ALL
 SELECT m.job_id, min(m.seq) AS seq, min(m.us) AS us FROM chain c
 JOIN matched m ON m.job_id = c.job_id AND m.us - c.us >= m.gap AND m.seq > c.seq GROUP BY m.job_id),
shown AS (SELECT m.job_id, m.seq, m.ts, m.line FROM matched m JOIN chain USING (job_id, seq))"""


_GAP_OWN = "CASE converter WHEN 'tec-suite' THEN 500000 ELSE 1000000 END"
_GAP_LONG = str(round(THROTTLE_SEC * 1_000_000))

_EVENTS = f"""{_throttled(_GAP_LONG)},
ended AS (SELECT * FROM job_runs WHERE finished_at IS NOT NULL)
SELECT job_id, CAST(seq AS BIGINT) AS seq, CAST(0 AS INTEGER) AS sub, ts, 'heartbeat' AS event_type, CAST(NULL AS VARCHAR) AS text, CAST(beats AS INTEGER) AS num FROM ({_BEATS_FROM_START})
UNION ALL SELECT job_id, seq, 1, ts, 'log', line, NULL FROM shown
UNION ALL SELECT job_id, seq, 2, ts, 'progress', NULL, progress FROM ({_MONOTONIC})
UNION ALL SELECT id, NULL, 0, finished_at, 'heartbeat', NULL, CAST(pause // 15000000 AS INTEGER) FROM (
 SELECT id, finished_at, epoch_us(finished_at) - coalesce(last_us, epoch_us(CAST(started_at AS TIMESTAMP))) AS pause
 FROM ended LEFT JOIN (SELECT job_id, max(epoch_us(ts)) AS last_us FROM {_LINES} GROUP BY job_id) ON job_id = id) WHERE pause >= 15000000
UNION ALL SELECT id, NULL, 3, finished_at, 'error', 'container not found', NULL FROM ended WHERE exit_code = -1
UNION ALL SELECT id, NULL, 4, finished_at, 'done', NULL, coalesce(exit_code, -1) FROM ended"""

_FEED = _EVENTS[: _EVENTS.index("\nUNION ALL SELECT id")]

_STATE_WRITES = """SELECT id AS run_id, started_at AS changed_at, 0 AS pri, 'running' AS status, CAST(NULL AS TIMESTAMP) AS finished_at, CAST(NULL AS INTEGER) AS exit_code FROM job_runs
UNION ALL SELECT id, started_at + INTERVAL 10 MINUTE, 1, 'failed', started_at + INTERVAL 10 MINUTE, -2 FROM job_runs WHERE id % 7 = 0
UNION ALL SELECT id, finished_at, 2, CASE WHEN exit_code = 0 THEN 'success' ELSE 'failed' END, finished_at, exit_code FROM job_runs WHERE finished_at IS NOT NULL"""


def _state(order: str) -> str:
    return f"""SELECT run_id, status, finished_at, exit_code FROM (
 SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {order}) AS n FROM ({_STATE_WRITES})) WHERE n = 1"""


_HISTORY = f"""SELECT r.id, r.user_id, u.username, {_LABEL} AS label, r.started_at, {_DURATION} AS duration_seconds
 FROM job_runs r LEFT JOIN users u ON u.id = r.user_id"""

_ENTRIES = """(SELECT split_part(path, '/', 1) AS year, split_part(path, '/', 2) AS day, split_part(path, '/', 3) AS name
 FROM file_manifest)"""
_DAYS_COUNTED = f"""SELECT year, day, count(*) FILTER (WHERE regexp_full_match(name, '.+\\.[zZ][iI][pP]')) AS stations
 FROM {_ENTRIES} WHERE regexp_full_match(year, '[0-9]{{4}}_original') AND regexp_full_match(day, '[0-9]{{2,3}}') GROUP BY year, day"""

# Converter, ordinal, flag, kind, form key, default, mount.
_FLAG_TABLE = [
    ("tec-suite", 0, "-r", "volume", "root", "", "/data/rinex"),
    ("tec-suite", 1, "-j", "number", "jobs", "4", ""),
    ("tec-suite", 2, "-v", "checkbox", "verbose", "", ""),
    ("tec-suite", 3, "-k", "checkbox", "cleanup", "", ""),
    ("dat-parquet-handler", 0, "--direction", "text", "direction", "dat-to-parquet", ""),
    ("dat-parquet-handler", 1, "-s", "volume", "src", "", "/data/src"),
    ("dat-parquet-handler", 2, "-d", "volume", "dst", "", "/data/dst"),
    ("dat-parquet-handler", 3, "--overwrite", "checkbox", "overwrite", "", ""),
    ("abstec-suite", 0, "--dat-path", "volume", "dat_path", "", "/data/in"),
    ("abstec-suite", 1, "--output-dir", "volume", "output_dir", "", "/data/out"),
    ("abstec-suite", 2, "--workdir", "text", "workdir", "/data/workdir", ""),
    ("abstec-suite", 3, "--year", "number", "year", "", ""),
    ("abstec-suite", 4, "--day-of-year", "number", "day_of_year", "", ""),
    ("abstec-suite", 5, "--days", "text", "days", "", ""),
    ("abstec-suite", 6, "--site", "text", "site", "", ""),
    ("abstec-suite", 7, "--elevation-cutoff", "number", "elevation_cutoff", "10", ""),
    ("abstec-suite", 8, "--time-step-hours", "text", "time_step_hours", "0.5", ""),
    ("abstec-suite", 9, "--correction-coefficient", "text", "correction_coefficient", "0.97", ""),
    ("abstec-suite", 10, "--runner", "text", "runner", "auto", ""),
    ("abstec-suite", 11, "--execution-timeout-seconds", "number", "execution_timeout_seconds", "", ""),
    ("abstec-suite", 12, "--dry-run", "checkbox", "dry_run", "", ""),
]
_FLAG_VALUES = ", ".join(str(row) for row in _FLAG_TABLE)
_FLAG_ROWS = f"""WITH flags(converter, ordinal, flag, kind, form_key, fallback, mount) AS (VALUES {_FLAG_VALUES}),
raw AS (SELECT r.id, r.converter, f.ordinal, f.flag, f.kind, f.fallback, f.mount,
 json_extract_string(r.flags_json, '$.' || f.form_key) AS sent,
 trim(trim(json_extract_string(r.flags_json, '$.root_subpath')), '/') AS subpath
 FROM run_forms r JOIN flags f USING (converter)),
valued AS (SELECT *, CASE kind WHEN 'volume' THEN trim(coalesce(sent, fallback))
 WHEN 'checkbox' THEN CASE WHEN sent IN ('on', 'true', '1') THEN 'true' ELSE 'false' END
 WHEN 'number' THEN coalesce(nullif(sent, ''), fallback) ELSE coalesce(sent, fallback) END AS given FROM raw),
checked AS (SELECT *, kind = 'number' AND given <> '' AND NOT regexp_full_match(trim(given), '[0-9]+') AS bad FROM valued),
flag_rows AS (SELECT id, converter, ordinal, flag, bad,
 CASE WHEN kind = 'number' AND given <> '' AND NOT bad THEN CAST(CAST(trim(given) AS BIGINT) AS VARCHAR) ELSE given END AS value,
 CASE WHEN kind = 'checkbox' THEN given = 'true' ELSE given <> '' AND NOT bad END AS emitted,
 CASE WHEN kind = 'checkbox' THEN flag
  WHEN flag = '-r' THEN '--root ' || mount || CASE WHEN subpath = '' THEN '' ELSE '/' || subpath END
  WHEN kind = 'volume' THEN flag || ' ' || mount
  WHEN kind = 'number' THEN flag || ' ' || CAST(TRY_CAST(trim(given) AS BIGINT) AS VARCHAR)
  ELSE flag || ' ' || given END AS parts FROM checked)"""

_SAMPLES = "SELECT site, CAST(year AS INTEGER) AS year, CAST(doy AS INTEGER) AS doy, ts, sat, el, tec FROM tec_samples"


def _selected(condition: str) -> str:
    return f"""SELECT site, doy, ts, sat, round(el, 6) AS el, round(tec, 6) AS tec FROM tec_samples
 WHERE year = 2024 AND doy IN (3, 10, 17) AND {condition}"""


def _recent(keys: str, count: int) -> str:
    return f"""SELECT {keys}, rank, id FROM (SELECT *, row_number() OVER (
 PARTITION BY {keys} ORDER BY started_at DESC, id DESC) AS rank FROM job_runs) WHERE rank <= {count}"""


def _tail(count: int) -> str:
    return f"""SELECT job_id, seq, line FROM (SELECT *, row_number() OVER (
 PARTITION BY job_id ORDER BY seq DESC) AS n FROM {_LINES}) WHERE n <= {count}"""


# name -> (views, SQL)
_SQL: dict[str, tuple[str, str]] = {
    "history_page": ("job_runs users", f"{_HISTORY} ORDER BY r.started_at DESC, r.id DESC LIMIT 25 OFFSET 25"),
    "history_page_own": ("job_runs users", f"{_HISTORY} WHERE r.user_id = {OPERATOR_ID} ORDER BY r.started_at DESC, r.id DESC LIMIT 25"),
    "history_after": ("job_runs users", f"""SELECT id, user_id, username, label, started_at FROM ({_HISTORY})
 WHERE (started_at, id) < (TIMESTAMP '1998-06-15 00:00:00', 500) ORDER BY started_at DESC, id DESC LIMIT 25"""),
    "history_deep_page": ("job_runs users", f"""SELECT id, user_id, username, label, started_at FROM ({_HISTORY}
 ORDER BY r.started_at DESC, r.id DESC LIMIT 25 OFFSET {(DEEP_PAGE - 1) * 25})"""),
    "history_totals": ("job_runs users", """SELECT user_id, total, greatest(1, (total + 24) // 25) AS total_pages FROM (
 SELECT u.id AS user_id, CASE WHEN u.role = 'admin' THEN (SELECT count(*) FROM job_runs)
 ELSE (SELECT count(*) FROM job_runs r WHERE r.user_id = u.id) END AS total FROM users u)"""),
    "run_visibility": ("job_runs users", """SELECT id AS run_id, 'role' AS "grant", CAST(NULL AS BIGINT) AS viewer_id FROM job_runs
 UNION ALL SELECT r.id, 'owner', r.user_id FROM job_runs r
 WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.id = r.user_id AND u.role = 'admin')"""),
    "run_access": ("access_requests job_runs users", """SELECT a.viewer_id, a.run_id, a.line, CASE WHEN u.id IS NULL THEN 'no_session'
 WHEN r.id IS NULL THEN 'not_found' WHEN u.role = 'admin' OR r.user_id = u.id THEN 'allowed' ELSE 'denied' END AS decision
 FROM access_requests a LEFT JOIN users u ON u.id = a.viewer_id AND u.is_active LEFT JOIN job_runs r ON r.id = a.run_id"""),
    "follow_access": ("access_requests job_runs users", """SELECT a.viewer_id, a.run_id, a.line, CASE WHEN u.id IS NULL THEN 'no_session'
 WHEN r.id IS NULL THEN 'not_found' WHEN u.role <> 'admin' AND r.user_id <> u.id THEN 'denied'
 WHEN coalesce(r.container_id, '') = '' THEN 'no_container' ELSE 'allowed' END AS decision
FROM access_requests a LEFT JOIN users u ON u.id = a.viewer_id AND u.is_active LEFT JOIN job_runs r ON r.id = a.run_id"""),
    "runs_of_active_users": ("job_runs users", """SELECT id, user_id, converter FROM job_runs
 WHERE user_id IN (SELECT id FROM users WHERE is_active)"""),
    "run_enriched": ("job_runs users", f"SELECT id, username, label, duration_seconds FROM ({_HISTORY})"),
    "run_flags": ("job_runs", """SELECT id, CAST(CASE WHEN ok THEN len(json_keys(flags_json)) ELSE 0 END AS INTEGER) AS n_flags,
 CASE WHEN ok THEN json_extract_string(flags_json, '$.jobs') END AS jobs,
 CASE WHEN ok THEN json_extract_string(flags_json, '$.auto_remove') END AS auto_remove
 FROM (SELECT *, json_valid(flags_json) AS ok FROM job_runs)"""),
    "run_auto_remove": ("job_runs", """SELECT id, CASE WHEN json_valid(flags_json)
 THEN lower(trim(json_extract_string(flags_json, '$.auto_remove'))) IN ('on', 'true', '1', 'yes') ELSE false END AS auto_remove FROM job_runs"""),
    "run_outcome": ("job_runs", """SELECT id, CASE WHEN exit_code = -1 AND id % 2 = 0 THEN 'error' WHEN exit_code = -2 THEN 'failed'
 WHEN code = 0 THEN 'success' ELSE 'failed' END AS status,
 CAST(CASE WHEN exit_code = -1 AND id % 2 = 0 THEN -1 WHEN exit_code = -2 THEN -2 ELSE code END AS INTEGER) AS exit_code
 FROM (SELECT *, CASE WHEN id % 5 = 0 THEN -1 ELSE exit_code END AS code FROM job_runs WHERE finished_at IS NOT NULL)"""),
    "run_state": ("job_runs", _state("changed_at DESC, pri DESC")),
    "run_state_incremental": ("job_runs", _state("changed_at DESC, pri DESC")),
    "run_state_first_terminal": ("job_runs", _state("(status = 'running'), changed_at, pri")),
    "recent_per_user": ("job_runs", _recent("user_id", 5)),
    "recent_per_user_converter": ("job_runs", _recent("user_id, converter", 3)),
    "log_tail": ("job_log_lines", _tail(5)),
    "log_tail_long": ("job_log_lines", _tail(1500)),
    "log_filter": ("job_log_lines", f"SELECT job_id, seq, line FROM {_LINES} WHERE {_SHOWN}"),
    "log_progress": ("job_log_lines", f"SELECT job_id, seq, {_PROGRESS} AS progress FROM {_LINES}"),
    "progress_monotonic": ("job_log_lines", _MONOTONIC),
    "idle_beats": ("job_log_lines", _BEATS),
    "idle_beats_from_start": ("job_log_lines job_runs", _BEATS_FROM_START),
    "log_throttle": ("job_log_lines", f"{_throttled(_GAP_LONG)} SELECT * FROM shown"),
    "log_throttle_own_interval": ("job_log_lines", f"{_throttled(_GAP_OWN)} SELECT * FROM shown"),
    "job_events": ("job_log_lines job_runs", _EVENTS),
    "feed_stream": ("job_log_lines job_runs", _FEED),
    "outcome_stream": ("job_runs", """SELECT id AS run_id, CASE WHEN finished_at IS NULL THEN 'running'
 WHEN code = 0 THEN 'success' ELSE 'failed' END AS status, finished_at,
 CASE WHEN finished_at IS NOT NULL THEN CAST(code AS INTEGER) END AS exit_code
 FROM (SELECT *, CASE WHEN id % 5 = 0 THEN -1 ELSE exit_code END AS code FROM job_runs)"""),
    "run_stops": ("access_requests job_runs users", """SELECT DISTINCT r.id AS run_id, 'failed' AS status, CAST(-2 AS INTEGER) AS exit_code
 FROM access_requests a JOIN job_runs r ON r.id = a.run_id JOIN users u ON u.id = a.viewer_id AND u.is_active
 WHERE r.finished_at IS NULL AND r.id % 7 <> 0 AND coalesce(r.container_id, '') <> '' AND (u.role = 'admin' OR u.id = r.user_id)"""),
    "archive_days": ("file_manifest", _DAYS_COUNTED),
    "archive_tree": ("file_manifest", f"""SELECT year, string_agg(day || ':' || CAST(stations AS VARCHAR), ','
 ORDER BY CAST(day AS INTEGER), length(day), day) AS days FROM ({_DAYS_COUNTED}) GROUP BY year"""),
    "request_validation": ("file_manifest", """SELECT path, converter, CASE converter WHEN 'retired-tool' THEN 'unknown_converter'
 WHEN 'tec-suite' THEN CASE WHEN path LIKE '%.txt' THEN 'blank_root'
  WHEN NOT regexp_full_match('/' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2), '/[0-9]{4}_original(/[0-9]{2,3})?') THEN 'bad_subpath'
  WHEN path LIKE '%7.zip' THEN 'bad_number' END END AS reject_reason
 FROM (SELECT path, CASE WHEN path LIKE '%9.zip' THEN 'retired-tool' WHEN path LIKE '%8.zip' THEN 'dat-parquet-handler' ELSE 'tec-suite' END AS converter FROM file_manifest)"""),
    "effective_flags": ("run_forms", f"""{_FLAG_ROWS} SELECT id, CAST(ordinal AS INTEGER) AS ordinal, flag, value, emitted, bad,
 CASE WHEN emitted THEN parts ELSE '' END AS args FROM flag_rows"""),
    "run_commands": ("run_forms", f"""{_FLAG_ROWS} SELECT r.id, c.command FROM run_forms r LEFT JOIN (
 SELECT id, CASE WHEN bool_or(bad) THEN NULL ELSE concat_ws(' ', string_agg(parts, ' ' ORDER BY ordinal) FILTER (WHERE emitted),
  CASE WHEN any_value(converter) = 'tec-suite' THEN '-c /app/tecs.cfg -t /app/tecs.py' END) END AS command
 FROM flag_rows GROUP BY id) c ON c.id = r.id"""),
    "day_list": ("day_requests", """WITH parts AS (SELECT id, trim(unnest(string_split(days, ','))) AS part FROM day_requests),
bounds AS (SELECT id, CAST(split_part(part, '-', 1) AS INTEGER) AS low,
 CAST(CASE WHEN part LIKE '%-%' THEN split_part(part, '-', 2) ELSE part END AS INTEGER) AS high
 FROM parts WHERE regexp_full_match(part, '[0-9]+(-[0-9]+)?'))
SELECT DISTINCT id, CAST(doy AS INTEGER) AS doy FROM (SELECT id, unnest(range(low, high + 1)) AS doy FROM bounds) WHERE doy BETWEEN 1 AND 366"""),
    "sample_select": ("tec_samples", _selected("site = 'site7'")),
    "sample_select_prefix": ("tec_samples", _selected("site LIKE 'site1%'")),
    "elevation_cutoff": ("tec_samples", "SELECT site, ts, sat, round(el, 6) AS el FROM tec_samples WHERE el >= 10"),
    "time_bins": ("tec_samples", """SELECT site, sat, time_bucket(INTERVAL '30 minutes', ts) AS bin_start, round(avg(tec), 6) AS tec, count(*) AS samples
 FROM tec_samples WHERE el >= 10 GROUP BY ALL"""),
    "pivot_export": ("tec_samples", "SELECT CAST(year AS INTEGER) AS year, CAST(doy AS INTEGER) AS doy, "
                     + ", ".join(f"round(avg(tec) FILTER (WHERE site = '{s}'), 6) AS {s}" for s in SITES)
                     + " FROM tec_samples GROUP BY year, doy"),
    "dat_to_parquet": ("tec_samples", _SAMPLES),
    "dat_roundtrip": ("tec_samples", _SAMPLES),
    "convert_incremental": ("tec_samples", _SAMPLES),
    "convert_overwrite": ("tec_samples", _SAMPLES),
    "archive_scan": ("tec_samples", """WITH days AS (SELECT DISTINCT 'year=' || CAST(year AS VARCHAR) AS y, 'doy=' || CAST(doy AS VARCHAR) AS d FROM tec_samples)
SELECT DISTINCT y AS path, true AS is_dir FROM days UNION ALL SELECT y || '/' || d, true FROM days
UNION ALL SELECT y || '/' || d || '/file', false FROM days"""),
    "log_text": ("job_log_lines", f"""SELECT CAST(job_id % 16 AS BIGINT) AS part, row_number() OVER (
 PARTITION BY job_id % 16 ORDER BY job_id, seq) - 1 AS seq, line FROM {_LINES}"""),
    "convert_pending": ("file_manifest", "SELECT path FROM file_manifest WHERE NOT (path LIKE '%1.zip' OR path LIKE '%/0%')"),
}

assert ADMIN_ID == 0  # the admin's pages are not filtered


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql, *views.split()) for name, (views, sql) in _SQL.items()}
