"""What changed between snapshots, against a plain set difference."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import snapshots
from gridloom.operators.snapshots import _differences, changed_values, snapshot_changes, yearbook_changes


def test_differences_agree_with_sets():
    rng = np.random.default_rng(1)
    n = 3000
    k = rng.integers(0, 400, n)
    version = rng.integers(2020, 2024, n)
    seen, keep = set(), []
    for i in range(n):
        if (k[i], version[i]) not in seen:
            seen.add((k[i], version[i]))
            keep.append(i)
    k, version = k[keep], version[keep]
    h = rng.integers(0, 3, len(k))
    handle = np.arange(len(k))
    yes = np.ones(len(k), bool)
    got = {(int(a), int(b), int(c)) for a, b, c in zip(*_differences(k % 7, k, version, h, handle, yes & (version > 2020), yes & (version < 2023)))}
    by = {(a, v): i for i, (a, v) in enumerate(zip(k, version))}
    want = set()
    for (a, v), i in by.items():
        if v > 2020:
            j = by.get((a, v - 1))
            if j is None:
                want.add((i, int(v), 0))
            elif h[i] != h[j]:
                want.add((i, int(v), 2))
        if v < 2023 and (a, v + 1) not in by:
            want.add((i, int(v) + 1, 1))
    assert got == want


def test_empty_and_null_keys(spark):
    schema = "k string, v long, h long, id long"
    empty = spark.createDataFrame([], schema)
    assert snapshot_changes(empty, ["k"], F.col("h"), "v", "id").count() == 0
    rows = spark.createDataFrame([(None, 1, 5, 1), (None, 2, 6, 2), ("a", 1, 1, 3), ("a", 2, 1, 4), ("b", 2, 1, 5)], schema)
    got = {tuple(r) for r in snapshot_changes(rows, ["k"], F.col("h"), "v", "id", F.col("v") > 1, F.col("v") < 2).collect()}
    assert got == {(2, 2, "changed"), (5, 2, "added")}


def test_yearbook_rules(spark):
    t = dt.datetime(2024, 1, 1)
    reports = spark.createDataFrame([(1, 2021, t, False), (2, 2022, t, True), (3, 2022, t + dt.timedelta(1), False), (4, 2022, t, False)], "id long, year int, imported_at timestamp_ntz, is_archived boolean")
    tables = spark.createDataFrame([(10, 1, "a"), (11, 3, "a"), (12, 4, "a"), (13, 3, "only now")], "id long, report_id long, code string")

    def grid(table_id, start, heads, rows):
        out = [(start + j, table_id, 0, j, h, None, True, "x") for j, h in enumerate(heads)]
        for i, r in enumerate(rows):
            out += [(start + 100 * (i + 1) + j, table_id, i + 1, j, v, None, False, "x") for j, v in enumerate(r)]
        return out

    cells = grid(10, 1000, ["l", "x", "y"], [["one", "1,000", "-"], ["two", "2", "b"], ["gone", "1", "1"], [None, "7", "7"]])
    cells += grid(11, 2000, ["l", "y", "x"], [["two​", "b", "3"], ["ｏne", None, "1000.0"], ["new", "1", "1"]])
    cells += [(5000, 11, 2, 0, "ｏne", None, False, "x")]  # delivered twice
    df = spark.createDataFrame(cells, "id long, table_id long, row_index int, col_index int, text_value string, numeric_value double, is_header boolean, unit string")
    got = {tuple(r) for r in yearbook_changes(spark, reports, tables, df).select("year", "code", "label_cell_id", "change_kind").collect()}
    assert got == {(2022, "a", 2100, "changed"), (2022, "a", 1300, "removed"), (2022, "a", 2300, "added")}
    values = {tuple(r)[2:] for r in changed_values(yearbook_changes(spark, reports, tables, df), df).collect()}
    assert values == {
        (2100, "changed", True, 2101, 1, "b"), (2100, "changed", True, 2102, 2, "3"), (2100, "changed", False, 1201, 1, "2"), (2100, "changed", False, 1202, 2, "b"),
        (1300, "removed", False, 1301, 1, "1"), (1300, "removed", False, 1302, 2, "1"), (2300, "added", True, 2301, 1, "1"), (2300, "added", True, 2302, 2, "1"),
    }


def test_tables_of_many_blocks(spark, monkeypatch):
    """Blocks of two rows give what one block gives; a label that many rows share is one record; empty tables have no rows."""
    t = dt.datetime(2024, 1, 1)
    reports = spark.createDataFrame([(1, 2021, t, False), (2, 2022, t, False)], "id long, year int, imported_at timestamp_ntz, is_archived boolean")
    tables = spark.createDataFrame([(10, 1, "a"), (11, 2, "a")], "id long, report_id long, code string")
    rng = np.random.default_rng(3)
    cells = []
    for table_id in (10, 11):
        cells += [(table_id * 10_000 + j, table_id, 0, j, h, True) for j, h in enumerate(("l", "x", "y"))]
        for i in range(1, 60):
            name = "same" if i % 3 == 0 else f"r{i + (table_id == 11 and i > 50)}"
            row = (name, str(rng.integers(0, 2)), str(rng.integers(0, 2)))
            cells += [(table_id * 10_000 + i * 10 + j, table_id, i, j, v, False) for j, v in enumerate(row)]
    df = spark.createDataFrame(cells, "id long, table_id long, row_index int, col_index int, text_value string, is_header boolean")
    keep = lambda: {tuple(r)[:4] for r in yearbook_changes(spark, reports, tables, df).select("year", "code", "label_cell_id", "change_kind").collect()}
    whole = keep()
    monkeypatch.setattr(snapshots, "BLOCK", 2)
    assert keep() == whole and {k for *_, k in whole} == {"added", "removed", "changed"}
    assert yearbook_changes(spark, reports, tables, df.limit(0)).count() == 0
