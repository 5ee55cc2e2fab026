"""Inference: where profiles come from, and the generators of candidates on literal grids."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.operators import infer

SF = "/root/testdata/sf0.001"
CELL = "table_id long, row_index int, col_index int, text_value string, numeric_value double, is_header boolean"


def grid(spark, matrix, header_rows=1):
    return spark.createDataFrame([(1, i, j, str(v), None, i < header_rows) for i, r in enumerate(matrix) for j, v in enumerate(r) if v is not None], CELL)


GRIDS = {
    1: [["구분", "2025"], ["총계", 30], ["소계 A", 10], ["A-1", 4], ["A-2", 6], ["소계 B", 20], ["B-1", 8], ["B-2", 12]],
    2: [["구분", "2024", "2025"], ["계 Total", 60, 80], ["지방세 세목별 per Item", 10, 20], ["주민등록", 20, 25], ["소득", 30, 35]],
    3: [["순위", "2024", "2025"], ["1", 0.8, 0.9], ["2", 0.3, 0.4], ["3", 0.5, 0.5]],
    4: [["구분", "2024", "2025"], ["일반직", 30, 40], ["직급 A", 10, 15], ["직급 B", 20, 25], ["특정직", 5, 6]],
    5: [["구분", "2023", "2024", "2025"], ["자산", 210, 223.2, 231.7], ["부채", 54.4, 56.3, 61.3], ["자본", 155.6, 166.9, 170.3]],
    6: [["기관", "건수", "기관", "수량"], ["계", 10, None, None], ["가", 1, "나", 2], ["다", 3, "라", 4]],
    7: [["구분", "계", "갑", "을", "병"], ["가", 12, 5, 7, 100], ["나", 10, 1, 9, 300], ["다", 30, 20, 10, 50]],
    8: [["구분", "처리", "비용", "값"], ["건수", 10, 20, 30], ["비용", 100, 400, 900], ["1건당 비용", 10, 20, 30]],
    9: [["구분", "2024", "2025"], ["가", 1, 2], ["나", 3, 4], ["다", 5, 6], ["합계", 9, 12]],
}


def test_what_literal_grids_are_made_of(spark):
    """Subtotals before leaves, unlabelled sums, ranks that are none, one total over blocks side by side, sets of columns, quotients."""
    rows = [(t, i, j, str(v), None, i == 0) for t, m in GRIDS.items() for i, r in enumerate(m) for j, v in enumerate(r) if v is not None]
    found = infer.inferred(spark.createDataFrame(rows, CELL)).collect()
    sums = {(r.table_id, r.target_row): r.operand_rows for r in found if r.type == "column_sum"}
    assert sums[1, 1] == [2, 5] and sums[1, 2] == [3, 4] and sums[1, 5] == [6, 7]
    assert sums[2, 1] == [2, 3, 4]
    assert not any(t == 3 for t, _ in sums)
    assert sums[4, 1] == [2, 3] and sums[5, 1] == [2, 3]
    assert sums[9, 4] == [1, 2, 3]
    cells = {r.table_id: sorted((c.row, c.column) for c in r.operand_cells) for r in found if r.type == "cell_sum"}
    assert cells[6] == [(2, 1), (2, 3), (3, 1), (3, 3)]
    columns = {(r.table_id, r.target_column): r.operand_columns for r in found if r.type == "row_sum"}
    assert columns[7, 1] == [2, 3]
    quotient = [(r.target_row, r.numerator_row, r.denominator_rows) for r in found if r.type == "row_ratio_by_rows" and r.table_id == 8]
    assert (3, 2, [1]) in quotient


def test_drafts_of_a_model_and_registered_generators(spark):
    """A model's spec stays only if the data bear it out and its places exist; a table it has none for falls back; a generator can be added."""
    m = [["구분", "계", "갑", "을"], ["가", 12, 5, 7], ["나", 10, 1, 9], ["다", 30, 20, 10]]
    cells = spark.createDataFrame([(t, i, j, str(v), None, i == 0) for t in (1, 2) for i, r in enumerate(m) for j, v in enumerate(r)], CELL)
    tables = spark.createDataFrame([(1, "명"), (2, "명")], "id long, unit string")

    def model(cells, tables):
        t = tables.where("id = 1").selectExpr("id as table_id")
        good = infer.spec_rows(t, "row_sum", "sum", target_column=1, operand_columns=F.lit([2, 3]))
        bad = infer.spec_rows(t, "row_sum", "sum", target_column=2, operand_columns=F.lit([1, 3]))
        nowhere = infer.spec_rows(t, "row_sum", "sum", target_column=3, operand_columns=F.lit([-1, 2]))
        return good.unionAll(bad).unionAll(nowhere)

    got = {(r.table_id, r.source, r.target_column) for r in infer.drafts(cells, tables, model).where("type = 'row_sum'").collect()}
    assert got == {(1, "model", 1), (2, "fallback", 1)}
    try:
        infer.generator("mine")(lambda columns, rows, cells: infer.spec_rows(columns.select("table_id").distinct(), "row_sum", "sum", target_column=3, operand_columns=F.lit([2])))
        assert {r.target_column for r in infer.candidates(cells, ("mine",)).collect()} == {3}
    finally:
        del infer.GENERATORS["mine"]


def test_header_paths_of_totals(spark):
    """Nested, replaced and sibling totals of three header rows."""
    m = [["구분", "총계", "총계", "일반직", "일반직", "일반직", "특정직", "특정직"], ["구분", "계", "정원", "계", "임기제", "고위", "계", "경찰"], ["가", 30, 9, 10, 4, 6, 20, 20], ["나", 33, 9, 11, 5, 6, 22, 22], ["다", 36, 8, 12, 5, 7, 24, 24]]
    columns, _ = infer.structure(grid(spark, m, 2))
    got = {(r.col_index, tuple(r.operands)) for r in infer.operand_columns(columns, runs=False).collect()}
    assert {(3, (4, 5)), (1, (3, 6))} <= got
    found = {r.target_column: r.operand_columns for r in infer.inferred(grid(spark, m, 2), specs=infer.total_columns(columns)).collect()}
    assert found[3] == [4, 5] and found[1] == [3, 6]


def test_profiles_come_from_earlier_deliveries(spark):
    rows = [(90, "1", "a", "s", 1), (20, "1", "a", "s", 2), (30, "1", "b", "s", 3), (40, "2", "b", "s", 4), (50, "3", "c", "s", 4), (60, "1", "a", "x", 4), (70, "1", "a", "s", 2), (80, "4", None, "s", 4), (81, "1", "a", "s", None)]
    tables = spark.createDataFrame(rows, "table_id long, table_code string, title string, signature string, turn int")
    got = {r.table_id: (r.profile_id, r.origin) for r in infer.profiles(tables).collect()}
    draft = (None, "draft")
    assert got == {90: draft, 20: (90, "reused"), 70: (90, "reused"), 30: (70, "reused"), 40: (30, "inherited"), 50: draft, 60: draft, 80: draft, 81: draft}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_every_table_has_an_origin_before_it(spark):
    reports = {r.id: r.imported_at for r in spark.read.parquet(f"{SF}/annual_reports.parquet").collect()}
    at = {r.id: reports[r.report_id] for r in spark.read.parquet(f"{SF}/stat_tables.parquet").collect()}
    with_cells = {r.table_id for r in spark.read.parquet(f"{SF}/stat_table_cells.parquet").select("table_id").distinct().collect()}
    got = {r.table_id: r.profile_id for r in entry.queries()["infer_profile_origin"](spark, SF).collect()}
    assert set(got) == with_cells & set(at)
    assert all(at[p] < at[t] for t, p in got.items() if p is not None)


def test_ratio_of_a_wide_grid(spark):
    width = 14
    rows = [[f"행{i}", *[(i * 37 + j * j * 11) % 97 + 20 for j in range(width)]] for i in range(1, 7)]
    m = [["구분", *[f"값{'가나다라마바사아자차카타파하'[j]}" for j in range(width)], "비율(%)"], *[[*r, round(100 * r[3] / r[12], 3)] for r in rows]]
    cells = grid(spark, m)
    found = infer.inferred(cells, specs=infer.same_row_ratios(infer.structure(cells)[0])).collect()
    assert [(r.target_column, r.numerator_column, r.denominator_columns, r.multiplier) for r in found] == [(width + 1, 3, [12], 100.0)]


def yearbook(spark, at, tables, cells):
    """The two tables of the yearbook in a folder: tables (id, report_id, code), cells as of grid."""
    spark.createDataFrame(tables, "id long, report_id long, code string").write.parquet(f"{at}/stat_tables.parquet")
    spark.createDataFrame([(k, *c, None) for k, c in enumerate(cells)], f"id long, {CELL}, footnote_marker string").write.parquet(f"{at}/stat_table_cells.parquet")


def test_parts_of_every_split_table(spark, tmp_path):
    one = [["구분", "합계 Total", "가"], *[[f"행{'가나다라마바'[i]}", 10 + 3 * i, i] for i in range(6)]]
    two = [["구분", "나", "다"], *[[f"행{'가나다라마바'[i]}", 4 + i, 6 + i] for i in range(6)]]
    wrong = [["구분", "나", "다"], *[[f"행{'가나다라마바'[i]}", 4 + i, 6 + i + 5 * (i == 2)] for i in range(6)]]
    cells = [(t, i, j, str(v), None, i == 0) for t, m in ((11, one), (12, two), (21, one), (22, wrong), (31, two)) for i, r in enumerate(m) for j, v in enumerate(r)]
    yearbook(spark, tmp_path, [(11, 1, "7-1 표1"), (12, 1, "7-1 표2"), (21, 2, "7-1 표1"), (22, 2, "7-1 표2"), (31, 2, "7-2")], cells)
    got = {(r.table_id, r.row_index): r.passed for r in entry.queries()["xtb_split_parts"](spark, str(tmp_path)).collect()}
    assert got == {(t, i): (t, i) != (21, 3) for t in (11, 21) for i in range(1, 7)}


def test_sums_and_ratios_over_all_grids(spark, tmp_path):
    m = [["구분", "계", "가", "나", "비율(%)"], *[[f"행{'가나다라마'[i]}", 3 * i + 8, i + 4, 2 * i + 4, round(100 * (i + 4) / (3 * i + 8), 2)] for i in range(5)]]
    m[2][1] += 50
    cells = [(t, i, j, str(v), None, i == 0) for t in (3, 700) for i, r in enumerate(m) for j, v in enumerate(r)]
    yearbook(spark, tmp_path, [(3, 1, "1-1"), (700, 2, "1-1")], cells)
    sums = entry.queries()["chk_yearbook_sums"](spark, str(tmp_path)).where("type = 'row_sum'").collect()
    assert {(r.table_id, r.row_index): r.passed for r in sums} == {(t, i): i != 2 for t in (3, 700) for i in range(1, 6)}
    ratios = entry.queries()["chk_yearbook_ratios"](spark, str(tmp_path)).where("type = 'row_ratio' and passed").collect()
    assert {(3, 1), (700, 1)} <= {(r.table_id, r.row_index) for r in ratios}


def test_ratios_by_components_names_and_several_denominators(spark):
    m = [["구분", "갑 (a)", "을 (b)", "병 (c)", "율 (a/(b+c)*100)"], ["총인구", 200, 400, 500, 22.22], ["참여", 50, 80, 300, 13.16], ["기타", 7, 9, 11, 35], ["참여 비율", 25, 20, 60, 31.25],
         ["공개율", 75, 80, 90, 44.12], ["공개", 30, 8, 9, 176.47], ["비공개", 10, 2, 1, 333.33]]
    m[4][0] = "참여"
    two = [[("부문", "비율")[i == 4] if i else "부문", *r] for i, r in enumerate(m)]
    cells = grid(spark, two)
    columns, rows = infer.structure(cells)
    c = infer.component_ratio_rows(columns, rows).collect()
    assert (5, 6, (6, 7)) in {(r.target_row, r.numerator_row, tuple(r.denominator_rows)) for r in c}
    n = infer.named_ratio_rows(columns, rows).collect()
    assert {(r.target_row, r.numerator_row, r.denominator_rows[0]) for r in n} == {(4, 2, 1)}
    h = infer.header_formulas(columns).where("type = 'row_ratio'").collect()
    assert [(r.target_column, r.numerator_column, r.denominator_columns) for r in h] == [(5, 2, [3, 4])]
