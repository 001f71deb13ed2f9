import pytest

from runledger.operators import inventory
from runledger.sources.archive import scan_archive

TREE = [
    "2026_original/001/aksu0740.zip", "2026_original/001/alek0740.zip",
    "2026_original/001/note.txt", "2026_original/01/mini.zip",
    "2026_original/002/aksu006s05.zip", "2025_original/010/bldr006q19.zip",
]
DAYS = {("2026_original", "01"): 1, ("2026_original", "001"): 2, ("2026_original", "002"): 1,
        ("2025_original", "010"): 1}


def days_of(df):
    return {(r.year, r.day): r.stations for r in inventory.archive_days(df).collect()}


def tree_of(df):
    return [(r.year, [(d.day, d.stations) for d in r.days]) for r in inventory.archive_tree(df).collect()]


def manifest(spark, files, dirs=()):
    rows = [(p, False) for p in files] + [(p, True) for p in dirs]
    return spark.createDataFrame(rows, "path STRING, is_dir BOOLEAN")


def test_counts_and_order(spark):
    df = manifest(spark, TREE, ["misc"])
    assert days_of(df) == DAYS
    assert tree_of(df) == [
        ("2026_original", [("01", 1), ("001", 2), ("002", 1)]), ("2025_original", [("010", 1)]),
    ]


def test_files_on_disk(spark, tmp_path):
    for path in TREE:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    (tmp_path / "misc").mkdir()
    assert days_of(scan_archive(spark, str(tmp_path))) == DAYS
    assert days_of(scan_archive(spark, f"{tmp_path}/")) == DAYS


@pytest.mark.parametrize("root", ["", None, "  ", "/no/such/place"])
def test_missing_root_is_empty(spark, root):
    assert tree_of(scan_archive(spark, root)) == []


def test_names_that_do_not_count(spark):
    files = [
        "2024_original/003/.zip", "2024_original/003/A.ZiP", "2024_original/003/_x.zip",
        "2024_original/003/deep/b.zip", "2024_original/1/c.zip", "2024_original/1234/d.zip",
        "2024_original/x12/e.zip", "24_original/003/f.zip", "2024_original2/003/g.zip",
        "2024_original/004/h.zip.part", "2024_original/top.zip", "2024_original/05",
        "2023_original",
    ]
    dirs = ["2024_original/003", "2024_original/006", "2024_original/003/dir.zip", "2022_original"]
    df = manifest(spark, files, dirs)
    assert days_of(df) == {
        ("2024_original", "003"): 2, ("2024_original", "004"): 0, ("2024_original", "006"): 0,
    }
    # A year without valid days is listed; a file named like a year is not.
    assert tree_of(df) == [
        ("2024_original", [("003", 2), ("004", 0), ("006", 0)]), ("2022_original", []),
    ]


def test_roots_of_any_form(spark, tmp_path):
    (tmp_path / "x" / "arch" / "arch").mkdir(parents=True)
    (tmp_path / "x" / "arch" / "arch" / "a.zip").write_text("x")
    base = str(tmp_path)
    for root in (f"{base}/x//arch", f"{base}/x/./arch", f"{base}/x/arch/../arch", f"file:{base}/x/arch"):
        found = sorted(map(tuple, scan_archive(spark, root).collect()))
        assert found == [("arch", True), ("arch/a.zip", False)]
    assert scan_archive(spark, f"{base}/x/arch/arch/a.zip").count() == 0


def test_folders_without_files_and_names_spark_passes_over(spark, tmp_path):
    for path in [*TREE, "2026_original/003/_x.zip", "2026_original/003/.y.zip", "2026_original/004/.zip"]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    for path in ("misc", "2024_original/077", "2023_original"):
        (tmp_path / path).mkdir(parents=True)
    found = scan_archive(spark, str(tmp_path))
    assert days_of(found) == DAYS | {
        ("2026_original", "003"): 2, ("2026_original", "004"): 0, ("2024_original", "077"): 0,
    }
    assert [(y, len(d)) for y, d in tree_of(found)] == [
        ("2026_original", 5), ("2025_original", 1), ("2024_original", 1), ("2023_original", 0),
    ]
    paths = [r.path for r in found.collect()]
    assert len(paths) == len(set(paths)) and "misc" in paths
