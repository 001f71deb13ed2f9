import json

import pytest

from runledger import default_registry
from runledger.operators import commands, requests

REGISTRY = default_registry()
# The arguments that the converters expect.
FORM = {"root": "N:\\RINEX", "root_subpath": "/2026_original/001", "jobs": "10", "verbose": True,
        "cleanup": True}
TAIL = ["-c", "/app/tecs.cfg", "-t", "/app/tecs.py"]
ROOT = ["--root", "/data/rinex/2026_original/001"]


def command(spark, converter, form, **options):
    text = form if isinstance(form, str) else json.dumps(form)
    runs = spark.createDataFrame([(1, converter, text)], "id LONG, converter STRING, flags_json STRING")
    return commands.run_commands(runs, REGISTRY, **options).first().command


@pytest.mark.parametrize("change, expected", [
    ({}, [*ROOT, "-j", "10", "-v", "-k", *TAIL]),
    ({"root_subpath": "/2026_original"}, ["--root", "/data/rinex/2026_original", "-j", "10", "-v", "-k", *TAIL]),
    ({"root_subpath": ""}, ["--root", "/data/rinex", "-j", "10", "-v", "-k", *TAIL]),
    ({"jobs": "1"}, [*ROOT, "-j", "1", "-v", "-k", *TAIL]),
    ({"jobs": ""}, [*ROOT, "-j", "4", "-v", "-k", *TAIL]),
    ({"jobs": None}, [*ROOT, "-j", "4", "-v", "-k", *TAIL]),
    ({"jobs": " 007 "}, [*ROOT, "-j", "7", "-v", "-k", *TAIL]),
    ({"jobs": "0.5"}, None),
    ({"verbose": False}, [*ROOT, "-j", "10", "-k", *TAIL]),
    ({"verbose": "on", "cleanup": "1"}, [*ROOT, "-j", "10", "-v", "-k", *TAIL]),
    # Exact values only, unlike the lenient switch.
    ({"verbose": "True", "cleanup": " on "}, [*ROOT, "-j", "10", *TAIL]),
    ({"root": ""}, ["-j", "10", "-v", "-k", *TAIL]),
    ({"root": "  "}, ["-j", "10", "-v", "-k", *TAIL]),
])
def test_suite_command(spark, change, expected):
    assert command(spark, "tec-suite", {**FORM, **change}) == expected


def test_other_commands(spark):
    assert command(spark, "dat-parquet-handler", {"src": "/a", "dst": "", "overwrite": "true"}) == [
        "--direction", "dat-to-parquet", "-s", "/data/src", "--overwrite"]
    # A submitted blank text stays blank; a missing one takes the default.
    assert command(spark, "abstec-suite", {"dat_path": "/a", "year": "2026", "workdir": "", "days": "001-010"}) == [
        "--dat-path", "/data/in", "--year", "2026", "--days", "001-010", "--elevation-cutoff", "10",
        "--time-step-hours", "0.5", "--correction-coefficient", "0.97", "--runner", "auto"]
    assert command(spark, "retired-tool", {}) is None


def test_missing_checkboxes(spark):
    assert command(spark, "tec-suite", {}) == ["-j", "4", *TAIL]
    assert command(spark, "tec-suite", {}, from_form=False) == ["-j", "4", "-k", *TAIL]
    assert command(spark, "tec-suite", "{bad", from_form=False) == ["-j", "4", "-k", *TAIL]


def test_effective_flags_agree_with_the_command(spark):
    forms = [FORM, {}, {**FORM, "jobs": "x"}, {"root": None, "root_subpath": None}]
    runs = spark.createDataFrame(
        [(i, c, json.dumps(f)) for i, (c, f) in enumerate((c, f) for c in
         ["tec-suite", "dat-parquet-handler", "abstec-suite", "retired-tool"] for f in forms)],
        "id LONG, converter STRING, flags_json STRING",
    )
    flags = commands.effective_flags(runs, REGISTRY).orderBy("id", "ordinal").collect()
    built = {r.id: (r.converter, r.command) for r in commands.run_commands(runs, REGISTRY).collect()}
    assert len(flags) == 4 * (4 + 4 + 13)
    for run_id, (converter, command_line) in built.items():
        mine = [f for f in flags if f.id == run_id]
        if not mine or any(f.bad for f in mine):
            assert command_line is None
        else:
            tail = TAIL if converter == "tec-suite" else []
            assert [a for f in mine for a in f.args] + tail == command_line
    null_root = [f for f in flags if f.id == 3 and f.ordinal == 0][0]
    assert (null_root.value, list(null_root.args)) == ("None", ["--root", "/data/rinex/None"])


def test_validation(spark):
    good = {"root": "/r", "root_subpath": "/2026_original/001", "jobs": "4"}
    cases = [
        ("tec-suite", good, None),
        ("tec-suite", {**good, "root_subpath": " /2026_original/01 "}, None),
        ("tec-suite", {**good, "root_subpath": "/2026_original"}, None),
        ("tec-suite", {**good, "root": " "}, "blank_root"),
        ("tec-suite", {"root_subpath": "x"}, "blank_root"),
        ("tec-suite", {**good, "root_subpath": ""}, "bad_subpath"),
        ("tec-suite", {**good, "root_subpath": "/2026_original/1"}, "bad_subpath"),
        ("tec-suite", {**good, "root_subpath": "/2026_original/001/"}, "bad_subpath"),
        ("tec-suite", {**good, "root_subpath": "/../etc"}, "bad_subpath"),
        ("tec-suite", {**good, "jobs": "four"}, "bad_number"),
        ("dat-parquet-handler", {}, None),
        ("abstec-suite", {"year": "0.5"}, "bad_number"),
        ("nope", good, "unknown_converter"),
        ("", good, "unknown_converter"),
        (None, good, "unknown_converter"),
    ]
    asked = spark.createDataFrame(
        [(i, c, f) for i, (c, f, _) in enumerate(cases)],
        "id INT, converter STRING, form MAP<STRING,STRING>",
    )
    checked = requests.validate(asked, REGISTRY)
    got = {r.id: r.reject_reason for r in checked.collect()}
    assert got == {i: reason for i, (_, _, reason) in enumerate(cases)}
    good_ones = sum(reason is None for _, _, reason in cases)
    assert requests.accepted(checked).count() == good_ones
    assert requests.rejected(checked).count() == len(cases) - good_ones


def test_dimension_tables(spark):
    assert {r.name: r.emit_interval_sec for r in REGISTRY.converters_df(spark).collect()} == {
        "tec-suite": 0.5, "dat-parquet-handler": 1.0, "abstec-suite": 1.0}
    per_converter = {r.converter: r["count"] for r in REGISTRY.patterns_df(spark).groupBy("converter").count().collect()}
    assert per_converter == {"tec-suite": 2, "dat-parquet-handler": 2, "abstec-suite": 3}
    flags = REGISTRY.flags_df(spark)
    assert flags.count() == 21 and flags.where("is_volume").count() == 5
    assert REGISTRY.get("tec-suite").label == "TEC-Suite" and REGISTRY.get("nope") is None


def test_no_shuffle(spark):
    runs = spark.createDataFrame([(1, "tec-suite", "{}")], "id LONG, converter STRING, flags_json STRING")
    for df in (commands.run_commands(runs, REGISTRY), commands.effective_flags(runs, REGISTRY)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
