"""Run history, logs, archives and samples derived from general-purpose tables.

Each view is a list of SQL expressions that Spark and other engines read alike, so the
same text serves the DataFrame and the check queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class View:
    table: str
    columns: dict[str, str]
    distinct: bool = False

    def sql(self) -> str:
        picked = ", ".join(f"{expr} AS {name}" for name, expr in self.columns.items())
        return f"SELECT {'DISTINCT ' if self.distinct else ''}{picked} FROM {self.table}"

    def of(self, source: DataFrame) -> DataFrame:
        rows = source.selectExpr(*[f"{expr} AS {name}" for name, expr in self.columns.items()])
        return rows.distinct() if self.distinct else rows

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.of(spark.read.parquet(f"{sf_dir}/{self.table}.parquet"))

    def stream(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The same rows as a stream; files that arrive later would follow."""
        file = f"{self.table}.parquet"
        rows = spark.read.parquet(f"{sf_dir}/{file}")
        reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 16)
        # A stream watches a folder: the table's own, or the one its single file is in.
        if any(name.endswith(f"/{file}") for name in rows.inputFiles()):
            return self.of(reader.option("pathGlobFilter", file).parquet(sf_dir))
        return self.of(reader.parquet(f"{sf_dir}/{file}"))


_FINISHED = (
    "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE"
    " o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 7200 AS INT) END"
)
_EXIT_CODE = (
    "CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderstatus = 'F' THEN 0"
    " WHEN o_orderkey % 3 = 0 THEN -1 WHEN o_orderkey % 3 = 1 THEN -2 ELSE 1 END"
)
_CONVERTER = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'tec-suite'"
    " WHEN '2-HIGH' THEN 'dat-parquet-handler' WHEN '3-MEDIUM' THEN 'abstec-suite'"
    " ELSE 'retired-tool' END"
)
_FLAGS = (
    "CASE WHEN o_orderkey % 11 = 0 THEN '{bad json' ELSE"
    " concat('{\"jobs\": \"', CAST(o_orderkey % 8 + 1 AS STRING), '\", \"auto_remove\": ',"
    " CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '\"on\"'"
    " ELSE '\" YES \"' END, '}') END"
)
# Forms that use every kind of flag: blank, missing, padded and malformed values.
_FORM_FIELDS = {
    "root": "CASE o_orderkey % 5 WHEN 0 THEN '  ' ELSE concat('/mnt/r', CAST(o_orderkey % 7 AS STRING)) END",
    "root_subpath": "CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '/2024_original'"
    " WHEN 2 THEN ' /2024_original/042/ ' ELSE concat('/2024_original/', lpad(CAST(o_orderkey % 366 + 1 AS STRING), 3, '0')) END",
    "jobs": "CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN '0.5' WHEN 2 THEN ' 12 '"
    " WHEN 3 THEN '007' ELSE CAST(o_orderkey % 8 + 1 AS STRING) END",
    "verbose": "CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'on' WHEN 2 THEN 'True' ELSE '' END",
    "src": "CASE o_orderkey % 5 WHEN 1 THEN '' ELSE '/mnt/dat' END",
    "direction": "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'parquet-to-dat' ELSE 'dat-to-parquet' END",
    "overwrite": "CASE o_orderkey % 3 WHEN 0 THEN '1' ELSE 'no' END",
    "dat_path": "'/mnt/dat'",
    "year": "CASE o_orderkey % 7 WHEN 0 THEN 'soon' WHEN 1 THEN '' ELSE '2024' END",
    "days": "CASE o_orderkey % 2 WHEN 0 THEN '001-010' ELSE '' END",
    "time_step_hours": "CASE o_orderkey % 3 WHEN 0 THEN '' ELSE '0.25' END",
}
_FORM = (
    "concat('{', "
    + ", ', ', ".join(f"'\"{key}\": \"', {expr}, '\"'" for key, expr in _FORM_FIELDS.items())
    + ", '}')"
)

_LINE = """CASE event_type
  WHEN 'click' THEN concat('INFO: Completed ', CAST(CAST(floor(value) AS INT) AS STRING), ' / ', CAST(event_id % 500 AS STRING), ': site', CAST(user_id AS STRING), '.zip')
  WHEN 'view' THEN concat('INFO: PROGRESS: ', CAST(CAST(floor(value) AS INT) AS STRING), '%')
  WHEN 'purchase' THEN concat('Processing year=2024 day=', CAST(dayofyear(ts) AS STRING), ' site=s', CAST(user_id AS STRING), ' (', CAST(CAST(floor(value) AS INT) AS STRING), '/500)')
  WHEN 'signup' THEN concat('=== processing day folder: ', CASE WHEN event_id % 2 = 0 THEN '/data/rinex/' ELSE '' END, lpad(CAST(dayofyear(ts) AS STRING), 3, '0'), ' ===')
  ELSE CASE WHEN event_id % 4 = 0 THEN '' ELSE 'ERROR: <b> & "x"' END END"""

_PATH = (
    "concat(CASE WHEN l_linestatus = 'O' OR l_linenumber < 5"
    " THEN concat(CAST(year(l_shipdate) AS STRING), '_original') ELSE 'misc' END, '/',"
    " CASE WHEN l_linenumber = 7 THEN CAST(dayofyear(l_shipdate) AS STRING)"
    " ELSE lpad(CAST(dayofyear(l_shipdate) AS STRING), 3, '0') END,"
    " '/s', CAST(l_suppkey AS STRING),"
    " CASE l_returnflag WHEN 'N' THEN '.zip' WHEN 'A' THEN '.ZIP' ELSE '.txt' END)"
)
_DAYS = (
    "CASE o_orderkey % 6 WHEN 0 THEN '001,002,003'"
    " WHEN 1 THEN concat(lpad(CAST(dayofyear(o_orderdate) AS STRING), 3, '0'), '-', CAST(dayofyear(o_orderdate) + 5 AS STRING))"
    " WHEN 2 THEN concat('364-400,', CAST(o_orderkey % 10 AS STRING), '-2')"
    " WHEN 3 THEN concat('x, 5 ,5,', CAST(o_orderkey % 400 AS STRING))"
    " WHEN 4 THEN '10-8' ELSE '' END"
)

VIEWS = {
    "users": View("customer", {
        "id": "c_custkey",
        "username": "c_name",
        "role": "CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'operator' END",
        "is_active": "c_custkey % 10 <> 3",
    }),
    "job_runs": View("orders", {
        "id": "o_orderkey",
        "user_id": "o_custkey",
        "converter": _CONVERTER,
        "flags_json": _FLAGS,
        "container_id": "CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 5 THEN '' ELSE concat('c', CAST(o_orderkey AS STRING)) END",
        "started_at": "o_orderdate",
        "finished_at": _FINISHED,
        "exit_code": _EXIT_CODE,
    }),
    "run_forms": View("orders", {
        "id": "o_orderkey",
        "converter": _CONVERTER,
        "flags_json": _FORM,
    }),
    "job_log_lines": View("events", {
        "job_id": "user_id",
        "seq": "event_id",
        "ts": "ts",
        "converter": "CASE user_id % 3 WHEN 0 THEN 'tec-suite' WHEN 1 THEN 'dat-parquet-handler'"
        " ELSE 'abstec-suite' END",
        "line": _LINE,
    }),
    "file_manifest": View("lineitem", {"path": _PATH, "is_dir": "false"}, distinct=True),
    "tec_samples": View("events", {
        "site": "concat('site', CAST(user_id % 20 AS STRING))",
        "year": "CAST(year(ts) AS INT)",
        "doy": "CAST(dayofyear(ts) AS INT)",
        "ts": "ts",
        "sat": "concat('G', CAST(event_id % 32 + 1 AS STRING))",
        "el": "value % 90",
        "tec": "value",
    }),
    "access_requests": View("lineitem", {
        "viewer_id": "CASE WHEN l_linenumber = 1 THEN l_partkey - l_partkey % 50 ELSE l_partkey END",
        "run_id": "CASE WHEN l_linenumber = 7 THEN -1 - l_orderkey ELSE l_orderkey END",
        "line": "l_linenumber",
    }),
    "day_requests": View("orders", {"id": "o_orderkey", "days": _DAYS}),
}

SITES = [f"site{i}" for i in range(20)]


def view(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return VIEWS[name].frame(spark, sf_dir)


def stream(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return VIEWS[name].stream(spark, sf_dir)


def with_views(query: str, *names: str) -> str:
    """The query with the named views in front of it as common table expressions."""
    head = ", ".join(f"{name} AS ({VIEWS[name].sql()})" for name in names)
    joint = ", " if query.lstrip().upper().startswith("WITH ") else " "
    body = query.lstrip()[5:] if joint == ", " else query
    if body.lstrip().upper().startswith("RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body.lstrip()[10:]}"
    return f"WITH {head}{joint}{body}"
