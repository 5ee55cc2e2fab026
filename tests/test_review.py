"""Reports, reviews and sinks where SQL says nothing: orders, circles, failing models, files written and read again."""

import json

from pyspark.sql import functions as F

from gridloom.operators import edges, findings, language, report
from gridloom.plans.checks import _specs
from gridloom.sources import ingest


def test_totals_come_before_what_they_are_made_of(spark):
    """A chain of three, a check of another type, and two in a circle."""
    cell = lambda r, c, role: {"row": r, "col": c, "role": role}
    rows = [("c", 1, 3, 0, [cell(9, 0, "related")]), ("b", 1, 2, 0, [cell(3, 0, "related")]), ("a", 1, 1, 0, [cell(2, 0, "related"), cell(5, 0, "related")]), ("r", 1, 3, 0, [cell(1, 0, "related")]), ("x", 2, 1, 0, [cell(2, 0, "related")]), ("y", 2, 2, 0, [cell(1, 0, "related")])]
    h = spark.createDataFrame(rows, "spec_id string, table_id long, target_row int, target_col int, cells array<struct<row: int, col: int, role: string>>")
    kinds = spark.createDataFrame([(k, "비율 검수" if k == "r" else "합계 검수") for k in "abcrxy"], "spec_id string, type string")
    got = {(r.table_id, r.place): r.spec_id for r in report.calculation_order(h, kinds).collect()}
    assert [got[1, i] for i in (1, 2, 3, 4)] == ["a", "b", "c", "r"] and {got[2, 1], got[2, 2]} == {"x", "y"}
    assert report.calculation_order(h.limit(0), kinds).count() == 0


def test_a_model_that_fails(spark):
    """Answers that fail, are too few, or never come; every text gets a decision."""

    def client():
        calls = []

        def ask(texts):
            calls.append(texts)
            if len(texts) > 1 and "odd" in texts:
                return ["normal"]
            if texts == ["never"]:
                raise TimeoutError
            if len(calls) == 1:
                raise ConnectionError
            return ["normal"] * len(texts)

        return ask

    work = spark.createDataFrame([("1", "a"), ("2", "odd"), ("3", "never"), ("4", None)], "fingerprint string, value string").coalesce(1)
    got = {r.fingerprint: r.decision for r in language.review(work, client).collect()}
    assert got == {"1": "normal", "2": "normal", "3": "needs review", "4": "normal"}
    assert {r.decision for r in language.review(work, language.no_model).collect()} == {"open"}


def test_runs_and_profiles_are_replaced_not_doubled(spark, tmp_path):
    c = spark.createDataFrame([("s", 1, "row_sum", False, "오류 의심", "critical"), ("s", 2, "row_sum", True, "정상", "info")], "spec_id string, table_id long, type string, passed boolean, status string, severity string")
    for run in ("r1", "r2", "r1"):
        findings.save_run(c, str(tmp_path / "runs"), run)
    checks, issues = (spark.read.parquet(str(tmp_path / "runs" / k)) for k in ("checks", "issues"))
    assert checks.groupBy("run_id").count().orderBy("run_id").collect() == [("r1", 2), ("r2", 2)] and issues.count() == 2
    p = spark.createDataFrame([(1, "old"), (2, "kept")], "table_id long, profile string")
    for turn, df in ((1, p), (2, p.where("table_id = 1").withColumn("profile", F.lit("new"))), (1, p)):
        ingest.store_profiles(df, str(tmp_path / "profiles"), turn)
    assert {(r.table_id, r.profile) for r in ingest.stored_profiles(spark, str(tmp_path / "profiles"), ["table_id"]).collect()} == {(1, "new"), (2, "kept")}


def test_files_written_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a, "b"'), (1, "line\nbreak"), (3, None)], "id int, text string")
    assert ingest.export_csv(df.where("id <> 1"), str(tmp_path / "csv"), ["id"]) == 2
    rows = sorted(json.loads(r.value)["id"] for r in ingest.to_json_rows(df).collect())
    assert rows == [1, 2, 3]
    (tmp_path / "d.json").write_text('[{"source": "가", "target": "a"},\n {"source": "나", "target": "b"}]', encoding="utf-8")
    assert {r.source for r in ingest.dictionary(spark, str(tmp_path / "d.json")).collect()} == {"가", "나"}
    (tmp_path / "d.csv").write_bytes("code,name\n01,서울\n02,부산\n".encode("euc-kr"))
    assert [tuple(r) for r in ingest.lookup_csv(spark, str(tmp_path / "d.csv"), "code string, name string", "EUC-KR").orderBy("code").collect()] == [("01", "서울"), ("02", "부산")]


def test_database_reads_are_parted():
    o = ingest.jdbc_options("jdbc:postgresql://h/d", "cells", key="id", low=1, high=1_000_000, parts=64)
    assert o["numPartitions"] == "64" and o["partitionColumn"] == "id" and o["upperBound"] == "1000000"
    assert "partitionColumn" not in ingest.jdbc_options("u", "t")


def test_selectors_of_relations(spark):
    """The cumulative total against the year of the latest row, minus another; a selector without a row leaves its spec out."""
    m = [["구분", "값"], ["누적 계", "141"], ["2025년", "103"], ["2026년", "141"]]
    cells = spark.createDataFrame([(t, i, j, v, None, i == 0) for t in (1, 2) for i, r in enumerate(m if t == 1 else m[:1] + m[2:]) for j, v in enumerate(r)], "table_id long, row_index int, col_index int, text_value string, numeric_value double, is_header boolean")
    specs = _specs(spark, "cell_relation_sum", cells.select("table_id").distinct(), target_column="1")
    slots = specs.select("spec_id", F.explode(F.array(F.struct(F.lit("target_row").alias("slot"), F.lit("cumulative_total").alias("selector")), F.struct(F.lit("operand").alias("slot"), F.lit("latest_year").alias("selector")))).alias("s")).select("spec_id", "s.*", F.lit(1).alias("column"), F.lit("+").alias("op"))
    got = edges.evaluate(edges.resolved(specs, cells, slots), cells, ["cell_relation_sum"]).collect()
    assert [(r.table_id, r.row_index, r.current_value, r.expected_value, r.passed) for r in got] == [(1, 1, 141.0, 141.0, True)]
