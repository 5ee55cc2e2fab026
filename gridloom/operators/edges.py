"""All arithmetic checks of grids in one plan: every spec is compiled to targets and operand edges, evaluated by one join.

A spec is a row of SPEC. Compilers (one per spec type) turn specs into

    targets  spec_id, table_id, row, col, part           what is checked
    edges    target -> op_table, op_row, op_col, role, sign, pair   what it is computed from

both joined to the cells once; a grouped aggregate per target gives the expected value by the spec's formula, and the
check passes if current and expected differ by the tolerance at most. Specs whose coordinates lie outside of the grid
are dropped before edges are made. Cells are joined on their coordinates, so cost grows with edges, not with grids x specs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import labels as L
from gridloom.functions import numeric as N


def _struct(**kinds: str) -> T.StructType:
    of = {"int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "boolean": T.BooleanType(), "ints": T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(k, of[v] if isinstance(v, str) else v) for k, v in kinds.items()])


SPEC = _struct(
    spec_id="string", table_id="long", type="string", label="string", check_group="string", severity="string", failure_status="string", execute="boolean", confidence="double",
    tolerance="double", change_tolerance="double", multiplier="double", target_row="int", target_column="int", operand_columns="ints", operand_rows="ints", columns="ints",
    row_indices="ints", display_only_row_indices="ints", allow_single_operand="boolean", operand_cells=T.ArrayType(_struct(row="int", column="int", op="string")),
    terms=T.ArrayType(_struct(op="string", column="int")), numerator_column="int", numerator_row="int", denominator_row="int", denominator_columns="ints", denominator_rows="ints",
    current_column="int", previous_column="int", row_pairs=T.ArrayType(_struct(target_row="int", source_row="int", value_row="int", weight_row="int")),
    value_column="int", change_column="int", rate_column="int", weight_column="int", source_table_id="long", source_column="int", source_row="int", source_weight_column="int",
    source_columns="ints", score="int",
)
NORMAL, SUSPECT, REVIEW = "정상", "오류 의심", "확인 필요"
# Spec types whose tolerance is at least 1, and the default tolerances.
FLOORED = ("region_total", "column_sum", "cell_sum", "cell_relation_sum", "row_sum", "row_arithmetic", "row_ratio", "column_share_ratio", "row_ratio_by_rows", "cross_table_cell_match", "cross_table_row_sum", "cross_table_weighted_average")
DEFAULT_TOLERANCE = {"row_ratio": 0.15, "column_share_ratio": 0.15, "row_ratio_by_rows": 0.15, "row_growth_rate": 0.15, "row_year_over_year_rate": 0.15, "year_rows_change_rate": 0.15, "weighted_average": 0.05, "row_arithmetic": 0.5}
SHOWN_WHOLE = ("row_ratio", "column_share_ratio", "row_ratio_by_rows", "row_growth_rate")
#: type -> (formula, strict, target policy, operand policy, least operands)
PLAN = {
    "row_sum": ("SUM", True, "target", "operand", 0), "row_arithmetic": ("SUM", True, "target", "operand", 0), "cell_relation_sum": ("SUM", True, "target", "operand", 1),
    "cell_sum": ("SUM", True, "target", "operand", 2), "column_sum": ("SUM", False, "target", "operand", 2), "region_total": ("SUM", False, "target", "operand", 2),
    "row_ratio": ("RATIO", True, "raw", "raw", 1), "column_share_ratio": ("RATIO", True, "raw", "raw", 1), "row_ratio_by_rows": ("RATIO", True, "raw", "raw", 1),
    "row_growth_rate": ("GROWTH", True, "raw", "raw", 1), "row_year_over_year_rate": ("GROWTH", True, "target", "operand", 1), "year_rows_change_rate": ("GROWTH", True, "target", "operand", 1),
    "row_year_over_year_change_amount": ("DIFF", True, "raw", "raw", 1), "year_rows_change_amount": ("DIFF", True, "raw", "raw", 1), "weighted_average": ("WAVG", False, "target", "operand", 2),
    "cross_table_row_sum": ("SUM", True, "cross_null", "cross_zero", 1), "cross_table_weighted_average": ("WAVG", False, "leading", "leading_cross", 2), "cross_table_cell_match": ("MATCH", True, "cross_null", "cross_null", 1),
}


def extents(cells: DataFrame) -> DataFrame:
    """table_id, n_rows, n_cols, header_rows of each grid."""
    header = F.max(F.when(F.col("is_header"), F.col("row_index")))
    return cells.groupBy("table_id").agg((F.max("row_index") + 1).alias("n_rows"), (F.max("col_index") + 1).alias("n_cols"), F.coalesce(header + 1, F.lit(1)).alias("header_rows"))


def cell_values(cells: DataFrame) -> DataFrame:
    """The grid's cells with their value under each null policy."""
    n, t = F.col("numeric_value"), F.col("text_value")
    # Two steps: the text is parsed once, the policies only differ in what blanks and dashes count for.
    raw = cells.select("table_id", F.col("row_index").alias("row"), F.col("col_index").alias("col"), N.raw_value(n, t).alias("raw"), N.display(t).alias("shown"), N.leading_value(n, t).alias("leading"))
    v, d = F.col("raw"), F.col("shown")
    target = F.coalesce(v, F.when(d.isin(*N.SUM_DASHES), 0.0))
    cross = F.coalesce(v, F.when(d.isin(*N.CROSS_DASHES), 0.0))
    zero = F.when(d == "", 0.0)
    return raw.select(
        "table_id", "row", "col", "raw", target.alias("target"), F.coalesce(target, zero).alias("operand"),
        F.coalesce(cross, zero).alias("cross_zero"), cross.alias("cross_null"), "leading", F.regexp_replace("shown", "[,%]", "").rlike(r"^[-+]?[0-9]+$").alias("whole"),
    )


def _rows(s: DataFrame) -> DataFrame:
    """One row per (spec, data row): the rows listed, else all data rows."""
    every = F.when(F.col("n_rows") > F.col("header_rows"), F.sequence("header_rows", F.col("n_rows") - 1)).otherwise(F.array().cast("array<int>"))
    return s.withColumn("row", F.explode(F.array_distinct(F.coalesce("row_indices", every)))).where("row >= 0 and row < n_rows")


def _inside(*arrays: Column, of: str) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(F.forall(x, lambda v: (v >= 0) & (v < F.col(of))), F.lit(True)) for x in arrays))


def _edges(rows: DataFrame, col: Column, refs: Column, part: str = "") -> DataFrame:
    """Targets (row, col) with `refs`: array of struct(t, r, c, role, sign, pair), exploded; empty lists keep the target."""
    return rows.select("spec_id", "table_id", "type", "row", col.alias("col"), F.lit(part).alias("part"), F.explode_outer(refs).alias("e")).select("*", "e.*").drop("e")


def _ref(r: Column, c: Column, role: str, sign: Column | None = None, pair: Column | None = None, t: Column | None = None) -> Column:
    return F.struct(
        (F.col("table_id") if t is None else t).cast("long").alias("op_table"), r.cast("int").alias("op_row"), c.cast("int").alias("op_col"), F.lit(role).alias("role"),
        (F.lit(1.0) if sign is None else sign).alias("sign"), (F.lit(0) if pair is None else pair).cast("int").alias("pair"),
    )


def _sign(op: Column) -> Column:
    return F.when(op == "-", -1.0).otherwise(1.0)


def _row_sum(s: DataFrame) -> DataFrame:
    s = s.where(_inside(F.array("target_column"), F.col("operand_columns"), of="n_cols"))
    return _edges(_rows(s), F.col("target_column"), F.transform("operand_columns", lambda c: _ref(F.col("row"), c, "term")))


def _row_arithmetic(s: DataFrame) -> DataFrame:
    s = s.where(_inside(F.array("target_column"), F.transform("terms", lambda t: t["column"]), of="n_cols"))
    r = _rows(s).where(~F.coalesce(F.array_contains("display_only_row_indices", F.col("row")), F.lit(False)))
    return _edges(r, F.col("target_column"), F.transform("terms", lambda t: _ref(F.col("row"), t["column"], "term", _sign(t["op"]))))


def _row_ratio(s: DataFrame) -> DataFrame:
    s = s.where(_inside(F.array("target_column", "numerator_column"), F.col("denominator_columns"), of="n_cols"))
    refs = F.concat(F.array(_ref(F.col("row"), F.col("numerator_column"), "num")), F.transform("denominator_columns", lambda c: _ref(F.col("row"), c, "den")))
    return _edges(_rows(s), F.col("target_column"), refs)


def _column_share(s: DataFrame) -> DataFrame:
    s = s.where(_inside(F.array("target_column", "numerator_column"), of="n_cols") & _inside(F.array("denominator_row"), of="n_rows"))
    return _edges(_rows(s), F.col("target_column"), F.array(_ref(F.col("row"), F.col("numerator_column"), "num"), _ref(F.col("denominator_row"), F.col("numerator_column"), "den")))


def _columns(s: DataFrame) -> DataFrame:
    return s.withColumn("column", F.explode(F.array_distinct("columns"))).where("column >= 0 and column < n_cols").withColumn("row", F.col("target_row"))


def _ratio_by_rows(s: DataFrame) -> DataFrame:
    s = _columns(s.where(_inside(F.array("target_row", "numerator_row"), F.col("denominator_rows"), of="n_rows")))
    refs = F.concat(F.array(_ref(F.col("numerator_row"), F.col("column"), "num")), F.transform("denominator_rows", lambda r: _ref(r, F.col("column"), "den")))
    return _edges(s, F.col("column"), refs)


def _column_sum(s: DataFrame) -> DataFrame:
    s = _columns(s.where(_inside(F.array("target_row"), of="n_rows")))
    return _edges(s, F.col("column"), F.transform(F.filter("operand_rows", lambda r: (r >= 0) & (r < F.col("n_rows"))), lambda r: _ref(r, F.col("column"), "term")))


def _cell_sum(s: DataFrame) -> DataFrame:
    ok = F.filter("operand_cells", lambda x: (x["row"] >= 0) & (x["row"] < F.col("n_rows")) & (x["column"] >= 0) & (x["column"] < F.col("n_cols")))
    return _edges(s.withColumn("row", F.col("target_row")), F.col("target_column"), F.transform(ok, lambda x: _ref(x["row"], x["column"], "term", _sign(x["op"]))))


def _growth(s: DataFrame) -> DataFrame:
    s = s.where(_inside(F.array("target_column", "current_column", "previous_column"), of="n_cols"))
    return _edges(_rows(s), F.col("target_column"), F.array(_ref(F.col("row"), F.col("current_column"), "cur"), _ref(F.col("row"), F.col("previous_column"), "prev")))


def _yoy(s: DataFrame) -> DataFrame:
    """Neighbours in the sorted column list; the target row is compared with the values of the source row."""
    cols = F.filter(F.array_sort("columns"), lambda c: (c >= 0) & (c < F.col("n_cols")))
    s = s.withColumn("pair_of", F.explode("row_pairs")).where("pair_of.target_row < n_rows and pair_of.source_row < n_rows").withColumn("cols", cols).where("size(cols) > 1")
    s = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("cols") - 1))).withColumn("row", F.col("pair_of.target_row"))
    now, before, src = F.expr("cols[k]"), F.expr("cols[k - 1]"), F.col("pair_of.source_row")
    return _edges(s, now, F.array(_ref(src, now, "cur"), _ref(src, before, "prev")))


def _year_rows(s: DataFrame, column: str, part: str) -> DataFrame:
    s = s.where(f"{column} is not null and size(row_indices) > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("row_indices") - 1))).withColumn("row", F.expr("row_indices[k]"))
    s = s.where(_inside(F.array("value_column", column), of="n_cols") & _inside(F.col("row_indices"), of="n_rows"))
    return _edges(s, F.col(column), F.array(_ref(F.col("row"), F.col("value_column"), "cur"), _ref(F.expr("row_indices[k - 1]"), F.col("value_column"), "prev")), part)


def _weighted(s: DataFrame) -> DataFrame:
    s = _columns(s.where(_inside(F.array("target_row"), F.col("operand_rows"), of="n_rows")).withColumn("columns", F.coalesce("columns", F.array("target_column"))))
    refs = F.flatten(F.transform("operand_rows", lambda r, i: F.array(_ref(r, F.col("column"), "value", pair=i), _ref(r, F.col("weight_column"), "weight", pair=i))))
    return _edges(s, F.col("column"), refs)


def _cross_weighted(s: DataFrame) -> DataFrame:
    refs = F.flatten(F.transform("row_pairs", lambda p, i: F.array(_ref(p["value_row"], F.col("source_column"), "value", pair=i, t=F.col("source_table_id")), _ref(p["weight_row"], F.col("source_weight_column"), "weight", pair=i, t=F.col("source_table_id")))))
    return _edges(s.withColumn("row", F.col("target_row")), F.col("target_column"), refs)


def _cross_match(s: DataFrame) -> DataFrame:
    return _edges(s.withColumn("row", F.col("target_row")), F.col("target_column"), F.array(_ref(F.col("source_row"), F.col("source_column"), "value", t=F.col("source_table_id"))))


def _cross_row_sum(s: DataFrame, labels: DataFrame) -> DataFrame:
    """Own operand columns plus the source table's column or columns in the row of the same label (the last such row)."""
    own = labels.withColumnsRenamed({"label": "row_label", "row_index": "row"})
    src = labels.groupBy("table_id", "label").agg(F.max("row_index").alias("src_row")).withColumnsRenamed({"table_id": "source_table_id", "label": "row_label"})
    s = _rows(s).join(own, ["table_id", "row"]).join(src, ["source_table_id", "row_label"])
    refs = F.concat(F.transform(F.coalesce("operand_columns", F.array().cast("array<int>")), lambda c: _ref(F.col("row"), c, "term")), F.transform(F.coalesce("source_columns", F.array("source_column")), lambda c: _ref(F.col("src_row"), c, "term", t=F.col("source_table_id"))))
    return _edges(s, F.col("target_column"), refs)


COMPILERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "row_sum": _row_sum, "row_arithmetic": _row_arithmetic, "row_ratio": _row_ratio, "column_share_ratio": _column_share, "row_ratio_by_rows": _ratio_by_rows,
    "column_sum": _column_sum, "region_total": _column_sum, "cell_sum": _cell_sum, "cell_relation_sum": _cell_sum, "row_growth_rate": _growth, "row_year_over_year_rate": _yoy,
    "row_year_over_year_change_amount": _yoy, "year_rows_change_amount": lambda s: _year_rows(s, "change_column", ""), "weighted_average": _weighted,
    "cross_table_weighted_average": _cross_weighted, "cross_table_cell_match": _cross_match,
}


def row_labels(cells: DataFrame) -> DataFrame:
    """table_id, row_index, label: column 0 of the data rows, without blanks and marks, lower case."""
    label = F.lower(F.regexp_replace(F.coalesce("text_value", F.lit("")), r"(?U)[\s·,._\-()/%]+", ""))
    return cells.where("col_index = 0 and not is_header").select("table_id", "row_index", label.alias("label")).where("label <> ''")


def compile_specs(specs: DataFrame, cells: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The edges of all executable specs (of the given types, else of all); targets without operands have one row with null op_row."""
    s = specs.where("coalesce(execute, true)").join(extents(cells), "table_id")
    types = types or [*COMPILERS, "year_rows_change_rate", "cross_table_row_sum"]
    parts = [COMPILERS[t](s.where(F.col("type") == t)) for t in types if t in COMPILERS]
    if "year_rows_change_rate" in types:
        rate = s.where(F.col("type") == "year_rows_change_rate")
        parts += [_year_rows(rate, "rate_column", ""), _year_rows(rate, "change_column", "change")]
    if "cross_table_row_sum" in types:
        parts.append(_cross_row_sum(s.where(F.col("type") == "cross_table_row_sum"), row_labels(cells)))
    return reduce(DataFrame.unionByName, parts)


def evaluate(specs: DataFrame, cells: DataFrame, types: list[str] | None = None) -> DataFrame:
    """One row per check: spec_id, table_id, type, part, row_index, col_index, current_value, expected_value, difference, tolerance, passed, status, severity."""
    if types is not None:
        specs = specs.where(F.col("type").isin(*types))
    values = cell_values(cells)
    edges = compile_specs(specs, cells, types)
    plan = F.create_map(*[x for k, v in PLAN.items() if types is None or k in types for x in (F.lit(k), F.struct(F.lit(v[0]).alias("formula"), F.lit(v[1]).alias("strict"), F.lit(v[2]).alias("of_target"), F.lit(v[3]).alias("of_operand"), F.lit(v[4]).alias("least")))])
    meta = specs.select("spec_id", "type", "label", "severity", "failure_status", "check_group", "tolerance", "change_tolerance", "multiplier", F.coalesce("allow_single_operand", F.lit(False)).alias("single")).withColumn("plan", plan[F.col("type")]).select("*", "plan.*").drop("plan")
    pick = lambda kind: F.coalesce(*[F.when(kind == p, F.col(c)) for p, c in (("raw", "raw"), ("target", "target"), ("operand", "operand"), ("cross_zero", "cross_zero"), ("cross_null", "cross_null"), ("leading", "leading"))])
    e = edges.withColumn("plan", plan[F.col("type")]).select("*", "plan.of_operand", "plan.formula").drop("plan")
    op = values.withColumnsRenamed({"table_id": "op_table", "row": "op_row", "col": "op_col"})
    e = e.join(op, ["op_table", "op_row", "op_col"], "left")
    kind = F.when(F.col("of_operand") == "leading_cross", F.when(F.col("role") == "weight", F.lit("cross_null")).otherwise(F.lit("leading"))).otherwise(F.col("of_operand"))
    e = e.withColumn("v", pick(kind))
    key = ["spec_id", "table_id", "row", "col", "part"]
    # Values and weights of one pair meet first; pairs without one of them fall out.
    weighted = types is None or any(PLAN[t][0] == "WAVG" for t in types)
    wavg = e.where("formula = 'WAVG'").groupBy(*key, "pair").agg(F.max(F.when(F.col("role") == "value", F.col("v"))).alias("v"), F.max(F.when(F.col("role") == "weight", F.col("v"))).alias("w")).groupBy(*key).agg(
        F.sum(F.col("v") * F.col("w")).alias("vw"), F.sum(F.when(F.col("v").isNotNull() & F.col("w").isNotNull(), F.col("w"))).alias("w"), F.count_if(F.col("v").isNotNull() & F.col("w").isNotNull()).alias("n_pairs"))
    role = lambda r: F.sum(F.when(F.col("role") == r, F.col("sign") * F.col("v")))
    agg = e.groupBy(*key).agg(
        F.count("op_row").alias("n"), F.count_if(F.col("op_row").isNotNull() & F.col("v").isNull()).alias("n_null"),
        role("term").alias("term"), role("num").alias("num"), role("den").alias("den"), role("cur").alias("cur"), role("prev").alias("prev"), role("value").alias("match"),
    )
    agg = agg.join(wavg, key, "left") if weighted else agg.withColumns({c: F.lit(None).cast("double") for c in ("vw", "w", "n_pairs")})
    x = agg.join(meta, "spec_id").join(values, ["table_id", "row", "col"])
    change = F.col("part") == "change"
    mult = F.coalesce("multiplier", F.when(F.col("type").isin("row_ratio", "row_ratio_by_rows"), 1.0).otherwise(100.0))
    expected = (
        F.when(F.col("formula") == "SUM", F.coalesce("term", F.lit(0.0)))
        .when(F.col("formula") == "RATIO", F.when(F.col("den") != 0, mult * F.col("num") / F.col("den")))
        .when((F.col("formula") == "DIFF") | change, F.when(~change | (F.col("prev") != 0), F.col("cur") - F.col("prev")))
        .when(F.col("formula") == "GROWTH", F.when(F.col("prev") != 0, mult * (F.col("cur") - F.col("prev")) / F.col("prev")))
        .when(F.col("formula") == "WAVG", F.when((F.col("w") != 0) & (F.col("n_pairs") >= F.col("least")), F.col("vw") / F.col("w")))
        .when(F.col("formula") == "MATCH", F.col("match"))
    )
    least = F.when(F.col("single"), F.least("least", F.lit(1))).otherwise(F.col("least"))
    valid = F.when(F.col("formula") == "WAVG", True).when(F.col("strict"), (F.col("n_null") == 0) & (F.col("n") >= least)).otherwise(F.col("n") - F.col("n_null") >= least)
    default = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in DEFAULT_TOLERANCE.items() if types is None or k in types], F.lit(1.0))
    base = F.when(change, F.coalesce("change_tolerance", F.lit(1.0))).otherwise(F.coalesce("tolerance", default))
    floored = F.col("type").isin(*FLOORED) | F.col("check_group").isin("sum", "ratio")
    tol = F.greatest(F.when(floored & (F.col("type") != "cross_table_weighted_average") & (F.col("type") != "cross_table_cell_match"), F.greatest(base, F.lit(1.0))).otherwise(base), F.when(F.col("type").isin(*SHOWN_WHOLE) & (base <= 0.15) & F.col("whole"), F.lit(0.5)).otherwise(F.lit(0.0)))
    x = x.withColumn("current_value", pick(F.col("of_target"))).withColumn("expected_value", expected).withColumn("tolerance", tol).where(valid & F.col("current_value").isNotNull() & F.col("expected_value").isNotNull())
    passed = F.abs(F.col("current_value") - F.col("expected_value")) <= F.col("tolerance")
    severity = F.coalesce("severity", F.lit("warning"))
    failure = F.coalesce("failure_status", F.when(severity == "critical", SUSPECT).otherwise(REVIEW))
    return x.withColumn("passed", passed).select(
        "spec_id", "table_id", "type", "part", F.col("row").alias("row_index"), F.col("col").alias("col_index"), "current_value", "expected_value",
        F.when(~F.col("passed"), F.col("current_value") - F.col("expected_value")).alias("difference"), "tolerance", "passed",
        F.when(F.col("passed"), NORMAL).otherwise(failure).alias("status"), F.when(F.col("passed"), "info").otherwise(severity).alias("severity"),
    )


def source_checks(checks: DataFrame, specs: DataFrame, cells: DataFrame) -> DataFrame:
    """The outcome of each cross_table_row_sum check once more, at every source cell that went into it: spec_id, table_id (the source's), row_index, col_index, passed."""
    e = compile_specs(specs.where("type = 'cross_table_row_sum'"), cells, ["cross_table_row_sum"]).where("op_table <> table_id")
    at = e.select("spec_id", F.col("row").alias("row_index"), F.col("col").alias("target"), "op_table", "op_row", "op_col")
    c = checks.select("spec_id", "row_index", F.col("col_index").alias("target"), "passed")
    return at.join(c, ["spec_id", "row_index", "target"]).select("spec_id", F.col("op_table").alias("table_id"), F.col("op_row").alias("row_index"), F.col("op_col").alias("col_index"), "passed")


def skipped(specs: DataFrame, cells: DataFrame, checks: DataFrame) -> DataFrame:
    """Passed checks for what a spec leaves out: the display-only rows of row_arithmetic, and averages with too few operands (spec_id, table_id, type, row_index, col_index, current_value)."""
    v = cell_values(cells).select("table_id", F.col("row").alias("row_index"), F.col("col").alias("col_index"), F.col("target").alias("current_value"))
    shown = specs.where("type = 'row_arithmetic'").select("spec_id", "table_id", "type", F.explode("display_only_row_indices").alias("row_index"), F.col("target_column").alias("col_index"))
    few = specs.where("type in ('weighted_average', 'cross_table_weighted_average')").select("spec_id", "table_id", "type", F.col("target_row").alias("row_index"), F.explode(F.coalesce("columns", F.array("target_column"))).alias("col_index"))
    few = few.join(checks.select("spec_id", "row_index", "col_index"), ["spec_id", "row_index", "col_index"], "left_anti")
    return shown.unionByName(few).join(v, ["table_id", "row_index", "col_index"]).select("spec_id", "table_id", "type", "row_index", "col_index", "current_value")


def selected_rows(cells: DataFrame) -> DataFrame:
    """table_id, latest_year, cumulative_total, latest_data_row: rows of each grid that a spec may name instead of a number.

    The row of the greatest year among the labels (the last of equal ones), the first row of a cumulative total, and the
    last row with a number; null where there is none.
    """
    label = F.when(F.col("col_index") == 0, F.col("text_value"))
    key = F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)\s+", "")
    year = F.nullif(F.regexp_extract(key, r"^[’']?((?:19|20)\d{2})년?$", 1), F.lit("")).cast("int")
    number = (F.col("col_index") > 0) & N.raw_value(F.col("numeric_value"), F.col("text_value")).isNotNull()
    return cells.where("not is_header").groupBy("table_id").agg(
        F.max(F.struct(year.alias("y"), "row_index")).alias("at"), F.min(F.when(key.rlike("^(누적|누계)(총|합)?계?$"), F.col("row_index"))).alias("cumulative_total"), F.max(F.when(number, F.col("row_index"))).alias("latest_data_row")
    ).select("table_id", F.when(F.col("at.y").isNotNull(), F.col("at.row_index")).alias("latest_year"), "cumulative_total", "latest_data_row")


def resolved(specs: DataFrame, cells: DataFrame, selectors: DataFrame) -> DataFrame:
    """specs with their target_row, source_row and operand rows taken from selectors.

    selectors: spec_id, slot (target_row, source_row or operand), selector (a column of selected_rows), column, op. A
    spec with a selector that names no row is left out.
    """
    rows = selected_rows(cells)
    names = [c for c in rows.columns if c != "table_id"]
    stacked = rows.select("table_id", F.explode(F.array(*[F.struct(F.lit(c).alias("selector"), F.col(c).alias("row")) for c in names])).alias("s")).select("table_id", "s.*")
    where = specs.select("spec_id", "table_id", "source_table_id")
    s = selectors.join(where, "spec_id").withColumn("table_id", F.when(F.col("slot") == "source_row", F.col("source_table_id")).otherwise(F.col("table_id")))
    s = s.join(stacked, ["table_id", "selector"], "left")
    found = s.groupBy("spec_id").agg(
        F.count_if(F.col("row").isNull()).alias("open"), F.max(F.when(F.col("slot") == "target_row", F.col("row"))).alias("__t"), F.max(F.when(F.col("slot") == "source_row", F.col("row"))).alias("__s"),
        F.collect_list(F.when(F.col("slot") == "operand", F.struct("row", "column", "op"))).alias("__o"))
    out = specs.join(found, "spec_id", "left").where("coalesce(open, 0) = 0")
    cells_of = F.when(F.size("__o") > 0, F.concat(F.coalesce("operand_cells", F.array().cast(SPEC["operand_cells"].dataType)), "__o")).otherwise(F.col("operand_cells"))
    return out.withColumns({"target_row": F.coalesce("__t", "target_row"), "source_row": F.coalesce("__s", "source_row"), "operand_cells": cells_of}).select(*SPEC.names)


def coordinates_exist() -> Column:
    """Whether all rows and columns that a spec names, however deep, are numbers from 0 on."""
    flat = ("target_row", "target_column", "numerator_column", "numerator_row", "denominator_row", "current_column", "previous_column", "value_column", "change_column", "rate_column", "weight_column", "source_column", "source_row", "source_weight_column")
    lists = ("operand_columns", "operand_rows", "columns", "row_indices", "denominator_columns", "denominator_rows", "source_columns")
    deep = (("operand_cells", ("row", "column")), ("terms", ("column",)), ("row_pairs", ("target_row", "source_row", "value_row", "weight_row")))
    ok = [F.coalesce(F.col(c) >= 0, F.lit(True)) for c in flat]
    ok += [F.coalesce(F.forall(c, lambda v: v.isNotNull() & (v >= 0)), F.lit(True)) for c in lists]
    ok += [F.coalesce(F.forall(c, (lambda ks: lambda v: reduce(lambda a, b: a & b, (F.coalesce(v[k] >= 0, F.lit(True)) for k in ks)))(ks)), F.lit(True)) for c, ks in deep]
    return reduce(lambda a, b: a & b, ok)


#: Least confidence of specs that are run: sums of groups, and all else that a template gave.
GROUP_SUM, TEMPLATE = 0.6, 0.9


def executable(specs: DataFrame, known: tuple[str, ...] = (*PLAN, "metadata_required", "outlier_columns", "growth_rate_scan")) -> DataFrame:
    """The specs to run: of known types, not switched off, sure enough (see GROUP_SUM and TEMPLATE); unit_required counts as metadata_required, once a table."""
    s = specs.withColumn("type", F.when(F.col("type") == "unit_required", "metadata_required").otherwise(F.col("type"))).where(F.col("type").isin(*known) & F.coalesce("execute", F.lit(True)))
    sure = F.coalesce("confidence", F.lit(1.0))
    s = s.where(F.when(F.col("check_group") == "template", sure >= TEMPLATE).when(F.col("check_group") == "sum", sure >= GROUP_SUM).otherwise(True))
    w = W.partitionBy("table_id", F.when(F.col("type") == "metadata_required", F.lit("m")).otherwise(F.col("spec_id"))).orderBy("spec_id")
    return s.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def growth_scan(cells: DataFrame, specs: DataFrame) -> DataFrame:
    """table_id, labels, passed: every grid with growth labels, and whether it has a spec that checks growth rates."""
    labels = cells.where(L.is_growth(F.col("text_value")) & (F.col("is_header") | (F.col("col_index") == 0))).groupBy("table_id").agg(F.count("*").alias("labels"))
    has = specs.where(F.col("type").isin("row_growth_rate", "row_year_over_year_rate", "year_rows_change_rate")).select("table_id").distinct().withColumn("has", F.lit(True))
    return labels.join(has, "table_id", "left").select("table_id", "labels", F.coalesce("has", F.lit(False)).alias("passed"))


def highlights(specs: DataFrame, cells: DataFrame, types: list[str] | None = None) -> DataFrame:
    """spec_id, table_id, target_row, target_col, cells: the target and its operands in the same table, as array of (row, col, role)."""
    e = compile_specs(specs, cells, types)
    related = e.where("op_row is not null and op_table = table_id").select("spec_id", "table_id", "row", "col", F.struct(F.col("op_row").alias("row"), F.col("op_col").alias("col"), F.lit("related").alias("role")).alias("h"))
    own = e.select("spec_id", "table_id", "row", "col", F.struct("row", "col", F.lit("target").alias("role")).alias("h"))
    return own.unionAll(related).groupBy("spec_id", "table_id", F.col("row").alias("target_row"), F.col("col").alias("target_col")).agg(F.array_sort(F.collect_set("h")).alias("cells"))
