"""Queries of inference: specs found for the order grids and the yearbook grids, and how profiles are reused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import crosstable, edges, grids, infer
from gridloom.plans.checks import GRID, N, order_grid
from gridloom.plans.grids import cells_of
from gridloom.plans.planted import GRIDS, planted
from gridloom.plans.registry import query
from gridloom.session import cut, table


#: The grids without wrong values.
CLEAN = GRID.replace("THEN 2 ELSE", "THEN 0 ELSE")


@query("infer_total_columns", CLEAN + f"SELECT t AS table_id, {N + 1} AS target_column, {N} AS operands FROM (SELECT a.t, a.r, abs(a.v - sum(o.v)) <= 1 AS ok FROM g a JOIN g o ON a.t = o.t AND a.r = o.r AND o.c BETWEEN 1 AND {N} WHERE a.c = {N + 1} GROUP BY a.t, a.r, a.v) GROUP BY t HAVING avg(CASE WHEN ok THEN 1.0 ELSE 0 END) >= 0.6")
def infer_total_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_grid(spark, sf_dir, off=0)
    cells = cut(cells)
    found = infer.inferred(cells, specs=infer.total_columns(cut(infer.structure(cells)[0])))
    return found.select("table_id", "target_column", F.size("operand_columns").alias("operands"))


@query("infer_total_rows", CLEAN + f"SELECT t AS table_id, 6 AS target_row, 5 AS operands FROM (SELECT a.t, a.c, abs(a.v - sum(o.v)) <= 1 AS ok FROM g a JOIN g o ON a.t = o.t AND a.c = o.c AND o.r < 6 WHERE a.r = 6 GROUP BY a.t, a.c, a.v) GROUP BY t HAVING avg(CASE WHEN ok THEN 1.0 ELSE 0 END) >= 0.6")
def infer_total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_grid(spark, sf_dir, off=0)
    cells = cut(cells)
    found = infer.inferred(cells, specs=infer.total_rows(*map(cut, infer.structure(cells))))
    return found.select("table_id", "target_row", F.size("operand_rows").alias("operands"))


@query("infer_yearbook")
def infer_yearbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything inferred for the yearbook's grids, by type."""
    cells = cut(cells_of(spark, sf_dir))
    return infer.inferred(cells, table(spark, sf_dir, "stat_tables")).groupBy("type").agg(F.count("*").alias("specs"), F.count_distinct("table_id").alias("tables"))


#: Headers that say themselves that a column isn't to be summed up.
UNSUMMED = "%|퍼센트|비율|구성비|Detail|Ｄｅｔ"


@query("infer_planted", GRIDS + f""", u AS (SELECT DISTINCT table_id FROM cells WHERE is_header AND regexp_matches(text_value, '{UNSUMMED}')), x AS (SELECT table_id, count(DISTINCT c) AS cols, count(DISTINCT r) AS rows FROM v GROUP BY 1)
SELECT t.type, x.table_id FROM x, (VALUES ('row_sum'), ('column_sum')) t(type) WHERE rows >= 3 AND cols >= 3 AND x.table_id NOT IN (SELECT table_id FROM u)""")
def infer_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearbook's grids whose planted total column and planted total row got a spec (of grids with numbers in three rows and columns, no header of which forbids sums)."""
    cells, shape = planted(spark, sf_dir, off=0)
    cells = cut(cells)
    found = infer.inferred(cells).join(shape, "table_id")
    size = cells.where("not is_header and col_index > 0 and numeric_value is not null").join(shape, "table_id").where("col_index < width and row_index < last").groupBy("table_id").agg(F.count_distinct("col_index").alias("cols"), F.count_distinct("row_index").alias("rows")).where("cols >= 3 and rows >= 3")
    found = found.where("type = 'row_sum' and target_column = width or type = 'column_sum' and target_row = last").join(size, "table_id")
    return found.join(cells.where(F.col("is_header") & F.col("text_value").rlike(UNSUMMED)).select("table_id"), "table_id", "left_anti").select("type", "table_id").distinct()


@query("infer_profile_origin")
def infer_profile_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the tables of each delivery from those imported before it, by structure signature."""
    turn = table(spark, sf_dir, "annual_reports").where("imported_at is not null").select(F.col("id").alias("report_id"), F.dense_rank().over(W.orderBy("imported_at")).alias("turn"))  # a few rows
    t = table(spark, sf_dir, "stat_tables").select(F.col("id").alias("table_id"), F.col("code").alias("table_code"), "title", "report_id").join(turn, "report_id", "left").drop("report_id")
    return infer.profiles(t.join(grids.structure_signatures(cells_of(spark, sf_dir)), "table_id"))


SUMS = ["row_sum", "column_sum", "region_total", "row_arithmetic"]
RATIOS = ["row_ratio", "column_share_ratio", "row_ratio_by_rows"]


def _yearbook_checks(spark: SparkSession, sf_dir: str, types: list[str]) -> DataFrame:
    """Every candidate spec of the given types over all grids of the yearbook, one row per check."""
    cells = cut(cells_of(spark, sf_dir))
    return edges.evaluate(cut(infer.candidates(cells)), cells, types).select("spec_id", "table_id", "type", "row_index", "col_index", "current_value", "expected_value", "passed")


@query("chk_yearbook_sums")
def chk_yearbook_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _yearbook_checks(spark, sf_dir, SUMS)


@query("chk_yearbook_ratios")
def chk_yearbook_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _yearbook_checks(spark, sf_dir, RATIOS)


@query("xtb_split_parts")
def xtb_split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over the parts of every split table: the tables of a report whose codes differ in the part number alone."""
    t = table(spark, sf_dir, "stat_tables")
    parts = t.select(F.col("id").alias("table_id"), F.concat_ws("|", "report_id", crosstable.base_code(F.col("code"))).alias("base_code"), crosstable.part_number(F.col("code")).alias("part")).where("part is not null")
    cells = cut(cells_of(spark, sf_dir).join(parts.select("table_id"), "table_id", "left_semi"))
    out = crosstable.split_part_totals(cells, parts, least_passed=0.6)
    return out.select("table_id", "row_index", "col_index", "current_value", "expected_value", "passed")
