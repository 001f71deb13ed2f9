"""Schemas of the tables this package reads and writes."""

from pyspark.sql import types as T


def _schema(not_null: str = "", /, **columns: str | T.DataType) -> T.StructType:
    schema = T.StructType()
    for name, kind in columns.items():
        schema = schema.add(name, kind, nullable=name not in not_null.split())
    return schema


JOB_RUNS = _schema(
    "id user_id converter started_at status",
    id="long", user_id="long", converter="string", flags_json="string", rinex_path="string",
    output_path="string", container_id="string", started_at="timestamp",
    finished_at="timestamp", exit_code="integer", status="string",
)
USERS = _schema(
    "id username", id="long", username="string", role="string", is_active="boolean"
)

# seq numbers the lines of one run in order of arrival: (job_id, seq) is unique.
LOG_LINES = _schema(
    "job_id seq", job_id="long", seq="long", ts="timestamp", converter="string", line="string"
)
JOB_EVENTS = _schema(
    job_id="long", seq="long", sub="integer", ts="timestamp", event_type="string",
    text="string", num="integer",
)

# One row per write to a run's state; see runledger.operators.history.current_state.
LIFECYCLE = _schema(
    "run_id changed_at pri status",
    run_id="long", changed_at="timestamp", pri="integer", status="string",
    finished_at="timestamp", exit_code="integer",
)

MANIFEST = _schema(path="string", is_dir="boolean")

CONVERTERS = _schema(name="string", label="string", emit_interval_sec="double")
PROGRESS_PATTERNS = _schema(converter="string", ordinal="integer", pattern="string")
FLAGS = _schema(
    converter="string", ordinal="integer", name="string", long="string", type="string",
    default="string", required="boolean", is_volume="boolean", min="integer", max="integer",
    options=T.ArrayType(T.StringType()),
)

# A sample inside its file; year, doy and site come from the file's place.
SAMPLES = _schema(ts="timestamp_ntz", sat="string", el="double", tec="double")
