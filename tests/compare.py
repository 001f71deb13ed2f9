"""Runs a registered query on both engines and compares the rows."""

import math
from collections import Counter

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value


def _bag(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, Counter(tuple(_cell(v) for v in row) for row in zip(*columns))


def kinds(table):
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


def compare(spark, con, sf_dir, query, sql):
    """``(rows, differences)``; differences is empty when both agree."""
    mine = query(spark, sf_dir).toArrow()
    other = con.sql(sql).to_arrow_table()
    problems = []
    (names, rows), (other_names, other_rows) = _bag(mine), _bag(other)
    if names != other_names:
        return mine.num_rows, [f"columns {names} != {other_names}"]
    if mine.num_rows != other.num_rows:
        problems.append(f"{mine.num_rows} rows != {other.num_rows}")
    if rows != other_rows:
        problems.append(f"only here {list((rows - other_rows).items())[:2]}")
        problems.append(f"only there {list((other_rows - rows).items())[:2]}")
    a, b = kinds(mine), kinds(other)
    if a != b:
        problems.append("types " + str({n: (a[n], b[n]) for n in a if a[n] != b[n]}))
    return mine.num_rows, problems
