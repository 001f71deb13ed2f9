import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from runledger import schemas
from runledger.operators import convert, samples
from runledger.sources import dat

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def df(spark):
    rows = [
        ("aksu0010", 2024, 1, T0, "G01", 10.0, 1.0),
        ("aksu0010", 2024, 1, T0 + dt.timedelta(minutes=29), "G01", 45.0, 3.0),
        ("aksu0010", 2024, 1, T0 + dt.timedelta(minutes=30), "G01", 89.5, 5.5),
        ("aksu0010", 2024, 2, T0 + dt.timedelta(days=1), "G02", 9.9, 0.1 + 0.2),
        ("aksu0020", 2024, 1, T0, "G01", 50.0, 7.0),
        ("bldr0010", 2025, 1, T0 + dt.timedelta(days=366), "R05", 30.0, None),
    ]
    return spark.createDataFrame(
        rows, "site STRING, year INT, doy INT, ts TIMESTAMP_NTZ, sat STRING, el DOUBLE, tec DOUBLE"
    )


COLUMNS = ["site", "year", "doy", "ts", "sat", "el", "tec"]


def bag(frame):
    return sorted((tuple(r) for r in frame.select(COLUMNS).collect()), key=str)


def test_select(df):
    assert samples.select_samples(df, 2024, 1, "aksu0010").count() == 3
    assert samples.select_samples(df, 2024, [1, 2], "aksu", match="prefix").count() == 5
    assert samples.select_samples(df, 2024, 1, "aksu").count() == 0
    assert samples.select_samples(df).count() == 6
    with pytest.raises(ValueError):
        samples.select_samples(df, station="a", match="like")


def test_cutoff(df):
    assert samples.above_cutoff(df).count() == 5
    assert samples.above_cutoff(df, 0).count() == 6
    assert samples.above_cutoff(df, 90).count() == 0
    for bad in (-1, 90.5):
        with pytest.raises(ValueError):
            samples.above_cutoff(df, bad)


def test_bins(df):
    got = {(r.site, r.sat, r.bin_start): (r.tec, r.samples) for r in samples.time_bins(df).collect()}
    assert got[("aksu0010", "G01", T0)] == (2.0, 2)
    assert got[("aksu0010", "G01", T0 + dt.timedelta(minutes=30))] == (5.5, 1)
    assert got[("bldr0010", "R05", T0 + dt.timedelta(days=366))] == (None, 1)
    assert samples.time_bins(df, 24).where("site = 'aksu0010' AND sat = 'G01'").first().samples == 3
    with pytest.raises(ValueError):
        samples.time_bins(df, 0)


def test_pivot_and_csv(spark, df, tmp_path):
    table = samples.pivot_by_site(df, ["aksu0010", "aksu0020"])
    path = str(tmp_path / "csv")
    dat.export_csv(table, path)
    back = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    got = {(r.year, r.doy): (r.aksu0010, r.aksu0020) for r in back.collect()}
    assert got[(2024, 1)] == (pytest.approx(9.5 / 3), 7.0)
    assert got[(2025, 1)] == (None, None)


@pytest.mark.parametrize("spec, days", [
    ("001,002,003", [1, 2, 3]), ("001-365", list(range(1, 366))), ("364-400", [364, 365, 366]),
    ("0,1", [1]), ("3, 1 ,3", [1, 3]), ("5 - 7,6-8", [5, 6, 7, 8]), ("9-8", []), ("", []),
    ("x,4,-,5-,-6,1-2-3", [4]), ("999999999", []), ("99999999999", []),
])
def test_day_list(spark, spec, days):
    asked = spark.createDataFrame([(1, spec)], "id INT, days STRING")
    assert [r.doy for r in samples.day_list(asked).collect()] == days


def test_day_list_or_single_day(spark):
    asked = spark.createDataFrame(
        [(1, "001-002", None), (2, "", 9), (3, "001", 9), (4, None, 7)],
        "id INT, days STRING, day_of_year INT",
    )
    got = sorted((r.id, r.doy) for r in samples.day_list(asked, single="day_of_year").collect())
    assert got == [(1, 1), (1, 2), (2, 9), (4, 7)]


def test_dat_round_trip(spark, df, tmp_path):
    parquet, text, back = (str(tmp_path / n) for n in ("parquet", "text", "back"))
    dat.write_samples(df, parquet)
    assert os.path.isdir(f"{parquet}/year=2024/doy=1/site=aksu0010")
    convert.parquet_to_dat(spark, parquet, text, schemas.SAMPLES)
    convert.dat_to_parquet(spark, text, back, schemas.SAMPLES)
    assert bag(dat.read_samples(spark, back)) == bag(df)
    assert dat.read_samples(spark, back).where("bad_line IS NOT NULL").count() == 0
    # Nothing is converted twice.
    convert.dat_to_parquet(spark, text, back, schemas.SAMPLES)
    convert.parquet_to_dat(spark, parquet, text, schemas.SAMPLES)
    assert bag(dat.read_samples(spark, back)) == bag(df)
    assert bag(dat.read_dat(spark, text, schemas.SAMPLES)) == bag(df)


def write(root, place, *lines):
    path = os.path.join(root, place)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")


def test_plain_layout_comments_and_bad_lines(spark, tmp_path):
    root = str(tmp_path / "in")
    write(root, "2024/007/aksu/a.dat", "# a comment", "", "2024-01-07T00:00:00 G01  10.5\t1",
          "2024-01-07T00:00:30 G01 -", "2024-01-07T00:01:00 - x 1", "  2024-01-07T00:02:00 G02 - 2 ")
    write(root, "2024/008/aksu/a.dat", "2024-01-08T00:00:00 G01 20 2")
    write(root, "stray.dat", "2024-01-08T00:00:00 G01 20 2")
    rows = dat.read_dat(spark, root, schemas.SAMPLES).collect()
    assert len(rows) == 5
    assert sorted(r.bad_line for r in rows if r.bad_line) == [
        "2024-01-07T00:00:30 G01 -", "2024-01-07T00:01:00 - x 1"]
    good = sorted((r.doy, r.site, r.sat, r.el, r.tec, r.rel_path) for r in rows if not r.bad_line)
    assert good[0][:5] == (7, "aksu", "G01", 10.5, 1.0) and good[0][5] == "2024/007/aksu/a.dat"
    assert [r[:5] for r in good[1:]] == [(7, "aksu", "G02", None, 2.0), (8, "aksu", "G01", 20.0, 2.0)]
    assert dat.read_dat(spark, root, schemas.SAMPLES, subpath="/2024/008").count() == 1


def test_overwrite_replaces_files_and_keeps_the_rest(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    write(src, "2024/007/aksu/a.dat", "2024-01-07T00:00:00 G01 10 1")
    write(src, "2024/007/aksu/b.dat", "2024-01-07T00:00:00 G02 10 2")
    write(src, "2024/008/aksu/a.dat", "2024-01-08T00:00:00 G03 10 3")
    convert.dat_to_parquet(spark, src, dst, schemas.SAMPLES)
    newer = str(tmp_path / "newer")
    write(newer, "2024/007/aksu/a.dat", "2024-01-07T00:00:00 G01 10 9")

    def tec():
        return sorted((r.sat, r.tec) for r in dat.read_samples(spark, dst).collect())

    convert.dat_to_parquet(spark, newer, dst, schemas.SAMPLES)
    assert tec() == [("G01", 1.0), ("G02", 2.0), ("G03", 3.0)]
    convert.dat_to_parquet(spark, newer, dst, schemas.SAMPLES, overwrite=True)
    assert tec() == [("G01", 9.0), ("G02", 2.0), ("G03", 3.0)]


def test_text_that_would_break_a_line_is_refused(spark, df):
    broken = df.withColumn("sat", F.lit("G 1"))
    with pytest.raises(Exception, match="cannot be written"):
        dat.format_dat(broken, schemas.SAMPLES).collect()


def test_selection_prunes_folders(spark, df, tmp_path):
    path = str(tmp_path / "p")
    dat.write_samples(df, path)
    stored = samples.select_samples(dat.read_samples(spark, path), 2024, 1, "aksu0010")
    assert stored.count() == 3
    plan = stored._jdf.queryExecution().executedPlan().toString()
    pruned = plan[plan.index("PartitionFilters"):]
    assert all(c in pruned[:pruned.index("PushedFilters")] for c in ("year", "doy", "site"))


def test_sites_keep_their_names(spark, df, tmp_path):
    sites = ["0010", "007", "a b", "50%+c", "x=y"]
    odd = df.limit(1).select("year", "doy", "ts", "sat", "el", "tec").withColumn(
        "site", F.explode(F.array(*[F.lit(s) for s in sites])))
    parquet, text = str(tmp_path / "parquet"), str(tmp_path / "text")
    dat.write_samples(odd, parquet)
    assert sorted(r.site for r in dat.read_samples(spark, parquet).collect()) == sorted(sites)
    convert.parquet_to_dat(spark, parquet, text, schemas.SAMPLES)
    assert bag(dat.read_dat(spark, text, schemas.SAMPLES)) == bag(odd)
    write(str(tmp_path / "plain"), "2024/001/a b+/x.dat", "2024-01-01T00:00:00 G01 1 1")
    assert dat.read_dat(spark, str(tmp_path / "plain"), schemas.SAMPLES).first().site == "a b+"


def test_bad_lines_survive_both_ways(spark, tmp_path):
    src, mid, back = (str(tmp_path / n) for n in ("src", "mid", "back"))
    write(src, "2024/007/aksu/a.dat", "2024-01-07T00:00:00 G01 10 1", "what is this")
    convert.dat_to_parquet(spark, src, mid, schemas.SAMPLES)
    convert.parquet_to_dat(spark, mid, back, schemas.SAMPLES)
    lines = [r.bad_line for r in dat.read_dat(spark, back, schemas.SAMPLES).collect()]
    assert sorted(lines, key=str) == [None, "what is this"]


def test_pending(spark):
    source = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "path STRING")
    target = spark.createDataFrame([("a",), ("a",), ("z",)], "path STRING")
    assert sorted(r.path for r in convert.pending(source, target, ["path"]).collect()) == ["b", "b", "c"]


def test_day_numbers_of_any_length_and_refusals(spark):
    from runledger.operators.samples import day_list, refused_days

    rows = [(1, "364-10000000000", None), (2, "0000000001-3", None), (3, "1,2", "5"), (4, None, "500"), (5, None, "x"), (6, "", "7")]
    requests = spark.createDataFrame(rows, "id int, days string, day string")
    days = sorted((r.id, r.doy) for r in day_list(requests, single="day").collect())
    assert days == [(1, 364), (1, 365), (1, 366), (2, 1), (2, 2), (2, 3), (6, 7)]
    assert sorted(r.id for r in refused_days(requests).collect()) == [3, 4, 5]


def test_only_whole_json_objects_are_flags(spark):
    from pyspark.sql import functions as F
    from runledger.functions.runs import decode_flags

    texts = ['{"a": 1} junk }', '{"a": 1}{"b": 2}', "{'a': 1}", '{"a": 1}]', '{"a": 1}, {"b": 2}', "null", "[]", None, ' {"a": 1} ']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(decode_flags(F.col("t")).alias("f")).collect()
    assert [r.f for r in rows] == [{}] * 8 + [{"a": "1"}]


def test_streams_read_folder_tables(spark, tmp_path):
    from runledger.plans.queries import registered

    for name in ("orders", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    query = registered()["outcome_stream"]
    folder, file = (sorted(map(str, query(spark, d).collect())) for d in (str(tmp_path), "/root/testdata/sf0.001"))
    assert folder == file and len(folder) > 0


def test_later_samples_of_a_known_day_are_added(spark, df, tmp_path):
    parquet, text = str(tmp_path / "parquet"), str(tmp_path / "text")
    first = df.orderBy("site", "ts", "sat").limit(1)
    dat.write_samples(first, parquet)
    convert.parquet_to_dat(spark, parquet, text, schemas.SAMPLES)
    dat.write_samples(df.join(first, df.columns, "left_anti"), parquet)
    for _ in range(2):
        convert.parquet_to_dat(spark, parquet, text, schemas.SAMPLES)
        assert bag(dat.read_dat(spark, text, schemas.SAMPLES)) == bag(dat.read_samples(spark, parquet))


def test_only_dat_files_are_samples(spark, tmp_path):
    root = str(tmp_path / "in")
    write(root, "2024/007/aksu/a.dat", "2024-01-07T00:00:00 G01 10 1")
    write(root, "2024/007/aksu/notes.txt", "2024-01-07T00:00:00 G02 10 1")
    write(root, "2024/flat.dat", "2024-01-07T00:00:00 G03 10 1")
    assert [r.sat for r in dat.read_dat(spark, root, schemas.SAMPLES).collect()] == ["G01"]
    assert [r.path.split("/")[-1] for r in dat.misplaced_files(spark, root).collect()] == ["flat.dat"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nothing_new_reads_no_text(spark, tmp_path, monkeypatch):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    write(src, "2024/007/aksu/a.dat", "2024-01-07T00:00:00 G01 10 1")
    write(src, "2024/flat.dat", "2024-01-07T00:00:00 G09 10 1")
    convert.dat_to_parquet(spark, src, dst, schemas.SAMPLES)
    assert [tuple(r) for r in convert.ledger(spark, dst).collect()] == [("2024/007/aksu/a.dat", 29)]
    assert [(r.path.split("/")[-1], r.reason) for r in convert.left_out(spark, dst).collect()] == [
        ("flat.dat", "no year, day and site in its folders")]
    monkeypatch.setattr(dat, "read_dat", lambda *a, **b: pytest.fail("text was read"))
    monkeypatch.setattr(dat, "write_samples", lambda *a, **b: pytest.fail("samples were written"))
    convert.dat_to_parquet(spark, src, dst, schemas.SAMPLES)
    listing = plan_of(dat.dat_files(spark, src))
    assert "content" not in listing[listing.index("ReadSchema"):]


def test_only_new_files_are_opened(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    for day in ("007", "008", "009"):
        write(src, f"2024/{day}/aksu/a.dat", f"2024-01-{day[1:]}T00:00:00 G01 10 1")
    only = [r.file for r in dat.dat_files(spark, src).where("doy = 8").collect()]
    rows = dat.read_dat(spark, src, schemas.SAMPLES, only=only)
    assert [r.doy for r in rows.collect()] == [8] and rows.rdd.getNumPartitions() == 1
    convert.dat_to_parquet(spark, src, dst, schemas.SAMPLES)
    write(src, "2024/007/aksu/b.dat", "2024-01-07T00:00:30 G02 10 1")
    convert.dat_to_parquet(spark, src, dst, schemas.SAMPLES)
    assert sorted((r.doy, r.sat) for r in dat.read_samples(spark, dst).collect()) == [
        (7, "G01"), (7, "G02"), (8, "G01"), (9, "G01")]
    assert convert.ledger(spark, dst).count() == 4


def test_a_conversion_that_broke_off_is_repeated_once(spark, tmp_path, monkeypatch):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    write(src, "2024/007/aksu/a.dat", "2024-01-07T00:00:00 G01 10 1", "2024-01-07T00:00:30 G01 10 1")
    write(src, "2024/007/aksu/b.dat", "2024-01-07T00:00:00 G02 10 1")
    convert.dat_to_parquet(spark, src, dst, schemas.SAMPLES)
    write(src, "2024/007/aksu/c.dat", "2024-01-07T00:00:00 G03 10 1")

    def broken(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(convert, "_commit", broken)
        with pytest.raises(OSError):
            convert.dat_to_parquet(spark, src, dst, schemas.SAMPLES)
    convert.dat_to_parquet(spark, src, dst, schemas.SAMPLES)
    assert sorted(r.sat for r in dat.read_samples(spark, dst).collect()) == ["G01", "G01", "G02", "G03"]
