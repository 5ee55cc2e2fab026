"""Texts found again in grids: as brute force finds them, and many of them in tables of any size within a minute."""

import random
from contextlib import contextmanager
from threading import Timer

from pyspark.sql import functions as F

from gridloom.operators import language, report
from gridloom.operators.relational import first_holding

CELLS = "table_id long, row_index int, col_index int, text_value string"


@contextmanager
def within(spark, seconds):
    """Jobs that run longer are cancelled, which is an error."""
    timer = Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_first_holding_is_brute_force(spark):
    """Short and long terms, letters of two UTF-16 units, marks of regular expressions, terms without a text."""
    r = random.Random(3)
    word = lambda low, high: "".join(r.choice("ab.가😀😁") for _ in range(r.randint(low, high)))
    texts = [(key, word(1, 12), at) for at in range(400) for key in "xy"] + [("y", "\\Eab", 900), ("y", "aa\\Eabb", 800)]
    terms = [(key, word(1, 7)) for _ in range(150) for key in "xyz"] + [("y", "\\Eab"), ("y", "\\Ea"), ("x", None), (None, "a")]
    want = {}
    for key, k in {t for t in terms if None not in t}:
        if hits := [(int(t != k), at) for own, t, at in texts if own == key and k in t]:
            want[key, k] = min(hits)
    got = first_holding(spark.createDataFrame(terms, "c string, k string"), spark.createDataFrame(texts, "c string, t string, at int"), ["c"]).collect()
    assert len(got) == len(want) and {(x.c, x.k): (x.n, x.at) for x in got} == want
    assert {len(k) for _, k in want} >= {1, 2, 3, 4, 5} and {n for n, _ in want.values()} == {0, 1} and len(want) < len({t for t in terms})


def test_many_titles_in_many_tables(spark):
    """120,000 marks of as many codes, that no cell holds: every mark meets the tables of its code only."""
    n = 120_000
    t = spark.range(n).select("id", F.concat(F.lit("1-"), "id", F.lit(" 표1")).alias("code"), F.lit("t").alias("title"), F.concat(F.lit("Title of "), "id").alias("title_en"), F.lit("").alias("source"), F.lit("").alias("note"))
    m = t.select(F.col("id").alias("mark_id"), F.when(F.col("id") % 3 == 0, F.regexp_replace("code", " 표1", "")).otherwise(F.col("code")).alias("code"), F.when(F.col("id") % 2 == 0, F.col("title_en")).otherwise("No title").alias("text"), F.lit(None).cast("int").alias("col_index"))
    c = spark.range(n).select(F.col("id").alias("table_id"), F.lit(1).alias("row_index"), F.lit(1).alias("col_index"), F.lit("A longer text of a cell").alias("text_value"))
    with within(spark, 60):
        got = {tuple(r) for r in language.placed(m, t, c).groupBy("place", F.col("mark_id") % 2, F.col("mark_id").eqNullSafe(F.col("table_id"))).count().collect()}
    assert got == {("field", 0, True, n // 2), ("none", 1, False, n // 2)}


def test_many_marks_in_one_table(spark):
    """60,000 marks of one code and column: equal to cells, within cells, and in none."""
    n = 60_000
    t = spark.createDataFrame([(1, "9-1", "t", "", "", "")], "id long, code string, title string, title_en string, source string, note string")
    c = spark.range(n).select(F.lit(1).cast("long").alias("table_id"), F.col("id").cast("int").alias("row_index"), F.lit(2).alias("col_index"), F.format_string("facility-%06d of", "id").alias("text_value"))
    text = F.when(F.col("id") % 3 == 0, F.format_string("Facility-%06d of", "id")).when(F.col("id") % 3 == 1, F.format_string("-%06d", "id")).otherwise(F.format_string("%06d-", "id"))
    m = spark.range(n).select(F.col("id").alias("mark_id"), F.lit("9-1").alias("code"), text.alias("text"), F.lit(2).alias("col_index"))
    with within(spark, 60):
        got = {tuple(r) for r in language.placed(m, t, c).groupBy("place", F.col("mark_id") % 3, F.col("mark_id").eqNullSafe(F.col("row_index"))).count().collect()}
    assert got == {("cell", 0, True, n // 3), ("cell", 1, True, n // 3), ("none", 2, False, n // 3)}


def test_marks_with_and_without_a_column(spark):
    """Equal cells before those that hold it, also in a part of the code; marks without a column look in all; a mark given twice has one place; codes, texts and columns are missing."""
    t = spark.createDataFrame([(5, "1-2", "x", "Some Title", None, ""), (6, "1-2 표1", "y", "Other", "made by Q", None), (7, None, "z", "Q", "", ""), (8, "1-3", "w", "", "", "")], "id long, code string, title string, title_en string, source string, note string")
    c = spark.createDataFrame([(5, 1, 1, "Total of all"), (5, 2, 2, "to tal"), (6, 1, 1, " TOTAL"), (6, 1, 2, "all"), (5, 3, 3, None), (7, 1, 1, "Total"), (8, 1, None, "Total")], CELLS)
    rows = [(1, "1-2", "total", 1), (2, "1-2", "total", None), (3, "1-2", "total", 9), (4, "1-2", "l o f", None), (5, "1-2 표1", "of", None), (6, "1-2", "by q", None), (7, None, "total", None), (8, "1-2", " ", 1), (9, "1-2", None, None), (10, "1-2", "all", 1), (10, "1-2", "all", None), (11, "1-3", "tot", None), (12, "1-3", "tot", 1)]
    got = {r.mark_id: tuple(r)[1:] for r in language.placed(spark.createDataFrame(rows, "mark_id long, code string, text string, col_index int"), t, c).distinct().collect()}
    none = ("none", None, None, None)
    want = {1: ("cell", 6, 1, 1), 2: ("cell", 5, 2, 2), 3: none, 4: ("cell", 5, 1, 1), 5: none, 6: ("field", 6, None, None), 7: none, 8: none, 9: none, 10: ("cell", 6, 1, 2), 11: ("cell", 8, 1, None), 12: none}
    assert got == want


def test_many_issues_in_one_table(spark):
    """240,000 issues of one table: found as they are, within a cell, and not at all."""
    n = 240_000
    c = spark.range(n).select(F.lit(1).cast("long").alias("table_id"), F.col("id").cast("int").alias("row_index"), F.lit(0).alias("col_index"), F.format_string("Place %06d in", "id").alias("text_value"))
    text = F.when(F.col("id") % 3 == 0, F.format_string("place%06d in", "id")).when(F.col("id") % 3 == 1, F.format_string("E %06d", "id")).otherwise(F.format_string("%06d at", "id"))
    i = spark.range(n).select(F.col("id").alias("issue_id"), F.lit(1).cast("long").alias("table_id"), text.alias("found"))
    with within(spark, 60):
        got = {tuple(r) for r in report.issue_places(i, c).groupBy(F.col("issue_id") % 3, F.col("issue_id").eqNullSafe(F.col("row_index"))).count().collect()}
    assert got == {(0, True, n // 3), (1, True, n // 3), (2, False, n // 3)}
