import pytest
from pyspark.sql import functions as F

from runledger.functions import runs as R
from runledger.functions.progress import matches_any, percent
from runledger.functions.text import integer_text, is_yes, join_path, strip

# These log patterns and the first cases below, which state the expected progress.
PATTERNS = [
    r"Day\s+(\d+)\s*/\s*(\d+)", r"Processing.*?(\d+)\s*/\s*(\d+)",
    r"(\d+)\s*/\s*(\d+)\s+days", r"(-?\d+)\s*%",
]


def apply(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    got = rows.select("i", function(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(got, key=lambda r: r.i)]


@pytest.mark.parametrize("patterns, cases", [
    (PATTERNS, {
        "Day 3/14": 21, "Day 5/10": 50, "Processing archive 10/20": 50,
        "7/10 days processed": 70, "45% complete": 45, "150% done": 100, "-5%": 0,
        "No progress info here": None, "": None, "Starting...": None, "Day 0/0": None,
        "DAY 2/8": 25, "day 2/8": 25, "Day 29/100": 28,
        # A total of zero leaves the line to the next pattern.
        "Day 0/0 but 30%": 30, "Day 300/100": 100,
        "Day 99999999999999999999/3": 100,
        # A carriage return inside a line does not end it.
        "Processing\r 1/4": 25, "Day 1/2": 50,
    }),
    ([r"Completed\s+(\d+)\s*/\s*(\d+):\s+([\w.]+)"], {
        "Completed 101/132: spas0010.zip": 76, "Completed 1/4: 7": 25,
    }),
    ([r"folder:\s*([^\s]+)"], {"folder: 001": 1, "folder: /data/001": None, "folder: 999": 100}),
    ([r"(a)?(\d+)(?:/(\d+))?"], {"5": 5, "a5/10": 50, "5/10": 50}),
    # Only fractions may fall below zero.
    ([r"(-?\d+)/(\d+)"], {"-1/2": -50, "-1/0": None}),
    ([r"no group"], {"no group": None}),
    ([], {"50%": None}),
])
def test_percent(spark, patterns, cases):
    assert apply(spark, list(cases), lambda c: percent(c, patterns)) == list(cases.values())


def test_matches_any(spark):
    lines = ["Unzipping a", "Completed 101/132: b", "Deleted config", "completed 102/132: c"]
    pattern = [r"Completed\s+(\d+)\s*/\s*(\d+)"]
    assert apply(spark, lines, lambda c: matches_any(c, pattern)) == [False, True, False, True]
    assert apply(spark, lines, lambda c: matches_any(c, [])) == [True] * 4


def test_text_rules(spark):
    assert apply(spark, [" a ", "\t\x1c b\n", "", None], strip) == ["a", "b", "", None]
    yes = ["on", " TRUE ", "1", "Yes", "no", "", None, "2"]
    assert apply(spark, yes, is_yes) == [True] * 4 + [False] * 4
    numbers = {
        " 007 ": "7", "1_000": "1000", "-0": "0", "000": "0", "+5": "5", "-012": "-12",
        "0.5": None, "": None, " ": None, "_1": None, "1__0": None, "x": None,
        "123456789012345678901234567890": "123456789012345678901234567890",
    }
    assert apply(spark, list(numbers), integer_text) == list(numbers.values())
    paths = {"/2026_original/001": "/d/2026_original/001", "": "/d", "/": "/d",
             " a\\b/ ": "/d/a/b"}
    got = apply(spark, list(paths), lambda c: join_path(F.lit("/d/"), c))
    assert got == [p if p != "/d" else "/d/" for p in paths.values()]


def test_decode_flags(spark):
    cases = {
        '{"jobs": "4", "v": true, "n": 3, "z": null}': {"jobs": "4", "v": "true", "n": "3", "z": None},
        "{bad": {}, '{"a": 1': {}, '{"a": 1} x': {}, "[1]": {}, "null": {}, "": {}, "{}": {},
        ' {"a": {"b": 1}} ': {"a": '{"b":1}'},
    }
    assert apply(spark, list(cases), R.decode_flags) == list(cases.values())
    assert apply(spark, [None], R.decode_flags) == [{}]


def test_outcome(spark):
    rows = spark.createDataFrame(
        [(1, 0, None, False, False), (2, None, 0, False, False), (3, None, None, False, False),
         (4, 5, 0, False, False), (5, None, None, True, False), (6, 0, None, False, True)],
        "id INT, seen INT, looked_up INT, launch_failed BOOLEAN, stopped BOOLEAN",
    )
    code = R.resolve_exit_code(F.col("seen"), F.col("looked_up"))
    got = rows.select("id", R.outcome(code, F.col("launch_failed"), F.col("stopped")).alias("o"))
    assert {r.id: tuple(r.o) for r in got.collect()} == {
        1: ("success", 0), 2: ("success", 0), 3: ("failed", -1), 4: ("failed", 5),
        5: ("error", -1), 6: ("failed", -2),
    }


def test_duration(spark):
    rows = spark.sql(
        "SELECT TIMESTAMP '2026-01-01 00:00:00' AS a, TIMESTAMP '2026-01-01 00:02:00.5' AS b"
        " UNION ALL SELECT TIMESTAMP '2026-01-01 00:00:00', NULL"
    )
    got = [r.d for r in rows.select(R.duration_seconds(F.col("a"), F.col("b")).alias("d")).collect()]
    assert sorted(got, key=str) == [120.5, None]
