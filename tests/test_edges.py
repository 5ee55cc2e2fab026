"""The edge plan on literal grids: outcomes, null policies, tolerance floors, and an injected error flags exactly its checks."""

from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.operators import edges, findings, infer

CELL = "table_id long, row_index int, col_index int, text_value string, numeric_value double, is_header boolean"


def grid(spark, matrix, header_rows=1):
    return spark.createDataFrame([(1, i, j, v, None, i < header_rows) for i, r in enumerate(matrix) for j, v in enumerate(r) if v is not None], CELL)


def spec(spark, **f):
    row = {x.name: None for x in edges.SPEC.fields} | {"spec_id": "s", "table_id": 1, "severity": "critical"} | f
    return spark.createDataFrame([tuple(row[n] for n in edges.SPEC.names)], edges.SPEC)


def run(spark, matrix, **f):
    out = edges.evaluate(spec(spark, **f), grid(spark, matrix), [f["type"]])
    return sorted((r.row_index, r.col_index, r.current_value, r.expected_value, r.status) for r in out.collect())


M = [["구분", "계", "남", "여"], ["가", "11", "5", "5"], ["나", "12.1", "5", "5"], ["다", "-", "-", ""], ["라", "", "1", "1"], ["마", "5", "x", "5"]]


def test_row_sum_tolerance_and_nulls(spark):
    got = run(spark, M, type="row_sum", target_column=1, operand_columns=[2, 3], tolerance=0.0)
    assert got == [(1, 1, 11.0, 10.0, "정상"), (2, 1, 12.1, 10.0, "오류 의심"), (3, 1, 0.0, 0.0, "정상")]
    assert run(spark, M, type="row_sum", target_column=1, operand_columns=[2, 9]) == []


def test_column_sum_drops_nulls(spark):
    m = [["구분", "a"], ["계", "10"], ["가", "4"], ["나", "x"], ["다", "6"]]
    assert run(spark, m, type="column_sum", target_row=1, columns=[1, 7], operand_rows=[2, 3, 4, 99]) == [(1, 1, 10.0, 10.0, "정상")]
    assert run(spark, m, type="column_sum", target_row=1, columns=[1], operand_rows=[2]) == []
    assert run(spark, m, type="column_sum", target_row=1, columns=[1], operand_rows=[2], allow_single_operand=True) == [(1, 1, 10.0, 4.0, "오류 의심")]


def test_balance_and_skip(spark):
    m = [["구분", "잔액", "수입", "지출"], ["가", "-10", "100", "110"], ["나", "1", "5", "4"]]
    assert run(spark, m, type="row_arithmetic", target_column=1, terms=[("+", 2), ("-", 3)], display_only_row_indices=[2]) == [(1, 1, -10.0, -10.0, "정상")]


def test_weighted_average_drops_pairs(spark):
    m = [["구분", "평균", "명"], ["계", "37.5", ""], ["가", "30", "100"], ["나", "40", "300"], ["다", "x", "5"]]
    assert run(spark, m, type="weighted_average", target_row=1, columns=[1], operand_rows=[2, 3, 4], weight_column=2) == [(1, 1, 37.5, 37.5, "정상")]


def test_growth(spark):
    m = [["구분", "2025(a)", "2024(b)", "증감률"], ["가", "104", "100", "4"], ["나", "1", "0", "1"]]
    assert run(spark, m, type="row_growth_rate", target_column=3, current_column=1, previous_column=2) == [(1, 3, 4.0, 4.0, "정상")]


def test_injected_error_flags_its_checks(spark):
    m = [["구분", "계", "a", "b"], ["계", "21", "9", "12"], ["가", "10", "4", "6"], ["나", "11", "5", "6"]]
    rows = spec(spark, spec_id="r", type="row_sum", target_column=1, operand_columns=[2, 3])
    cols = spec(spark, spec_id="c", type="column_sum", target_row=1, columns=[1, 2, 3], operand_rows=[2, 3])
    specs = rows.unionAll(cols)
    ok = edges.evaluate(specs, grid(spark, m), ["row_sum", "column_sum"])
    assert ok.where(~F.col("passed")).count() == 0 and ok.count() == 6
    m[2][2] = "40"
    bad = edges.evaluate(specs, grid(spark, m), ["row_sum", "column_sum"]).where(~F.col("passed"))
    assert {(r.spec_id, r.row_index, r.col_index) for r in bad.collect()} == {("r", 2, 1), ("c", 1, 2)}
    h = edges.highlights(cols, grid(spark, m), ["column_sum"]).where("target_col = 2").first()
    assert [tuple(x) for x in h.cells] == [(1, 2, "target"), (2, 2, "related"), (3, 2, "related")]
    assert findings.rollup(ok).first().status == "정상"


def test_numbers(spark):
    want = {"3,456": 3456.0, "12.5%": 12.5, "12,34": None, "3ㅡ456": None, "257,702\n(123.2%)": 257702.0, "47.3(42.4%)": 47.3, "(12)": 12.0, "－": None, "１２": 12.0, "": None}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.v for r in df.select("t", N.parse_number(F.col("t")).alias("v")).collect()} == want


def test_inference_finds_the_totals(spark):
    m = [["구분", "계", "남", "여"], ["총계", "30", "14", "16"], ["가", "10", "4", "6"], ["나", "20", "10", "10"], ["다", "0", "0", "0"]]
    cells = grid(spark, m)
    found = infer.inferred(cells, specs=infer.total_columns(infer.structure(cells)[0]).unionAll(infer.total_rows(*infer.structure(cells))))
    got = {(r.type, r.target_column, r.target_row) for r in found.collect()}
    assert got == {("row_sum", 1, None), ("column_sum", None, 1)}
