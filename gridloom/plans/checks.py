"""Queries of the check algebra, over grids of yearly order counts: one grid a region, its nations in rows, years in columns.

Some values are off by 2, so that both outcomes of a check occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import crosstable, edges, findings
from gridloom.plans.registry import query
from gridloom.session import cut, table

YEARS = tuple(range(1995, 2002))
N = len(YEARS)


def order_grid(spark: SparkSession, sf_dir: str, off: int = 2) -> DataFrame:
    """Cells of the grids: header row 0, nations in rows 1.., their total last; label in column 0, years, total in column N + 1."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    counts = orders.join(customer, "o_custkey").groupBy("n_nationkey").pivot("y", list(YEARS)).agg(F.count(F.lit(1)))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    year = [F.coalesce(F.col(str(y)), F.lit(0)) for y in YEARS]
    rows = nation.join(counts, "n_nationkey", "left").select((F.col("n_regionkey") + 1).cast("long").alias("table_id"), "n_nationkey", "n_name", *[c.alias(f"y{y}") for c, y in zip(year, YEARS)])
    names = [f"y{y}" for y in YEARS]
    order = F.expr("row_number() over (partition by table_id order by n_nationkey)").cast("int")
    data = rows.select("table_id", order.alias("row_index"), F.col("n_name").alias("label"), *names)
    total = rows.groupBy("table_id").agg((F.count("*") + 1).cast("int").alias("row_index"), F.lit("합계").alias("label"), *[F.sum(c).alias(c) for c in names])
    wide = data.unionByName(total).withColumn("total", F.expr("+".join(names)))
    cells = wide.select("table_id", "row_index", F.posexplode(F.array(F.lit(None).cast("long"), *[F.col(c) for c in [*names, "total"]])).alias("col_index", "v"), "label")
    wrong = F.when((F.col("row_index") * 7 + F.col("col_index")) % 11 == 0, off).otherwise(0)
    value = F.when(F.col("col_index") > 0, F.col("v") + wrong)
    cells = cells.select("table_id", "row_index", "col_index", F.when(F.col("col_index") == 0, F.col("label")).otherwise(F.format_number(value, 0)).alias("text_value"), value.cast("double").alias("numeric_value"), F.lit(False).alias("is_header"))
    head = rows.select("table_id").distinct().select("table_id", F.lit(0).alias("row_index"), F.posexplode(F.array(*[F.lit(x) for x in ("구분", *map(str, YEARS), "합계")])).alias("col_index", "text_value"))
    return cells.unionByName(head.withColumns({"numeric_value": F.lit(None).cast("double"), "is_header": F.lit(True)}))


GRID = f"""
WITH base AS (SELECT c_nationkey AS k, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
nat AS (SELECT n_nationkey AS k, n_name, n_regionkey + 1 AS t, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation),
body AS (SELECT t, r, y - {YEARS[0] - 1} AS c, coalesce(n, 0) AS v FROM nat CROSS JOIN (SELECT unnest(range({YEARS[0]}, {YEARS[-1] + 1})) AS y) LEFT JOIN base USING (k, y)),
wide AS (SELECT * FROM body UNION ALL SELECT t, r, {N + 1}, sum(v) FROM body GROUP BY t, r),
clean AS (SELECT * FROM wide UNION ALL SELECT t, max(r) + 1, c, sum(v) FROM wide GROUP BY t, c),
g AS (SELECT CAST(t AS BIGINT) AS t, CAST(r AS INT) AS r, CAST(c AS INT) AS c, CAST(v AS DOUBLE) + CASE WHEN (r * 7 + c) % 11 = 0 THEN 2 ELSE 0 END AS v FROM clean)
"""
OUT = "t AS table_id, r AS row_index, c AS col_index, v AS current_value, round(e, 6) AS expected_value, abs(v - e) <= {tol} AS passed"


def _specs(spark: SparkSession, kind: str, tables: DataFrame, **fields) -> DataFrame:
    """One spec of a kind for every table; fields are SQL expressions."""
    names = {f.name: f.dataType.simpleString() for f in edges.SPEC.fields}
    given = {"spec_id": f"concat('{kind}:', table_id)", "table_id": "table_id", "type": f"'{kind}'", "severity": "'critical'"} | fields
    return tables.select(*[F.expr(f"cast({given.get(n, 'null')} as {t})").alias(n) for n, t in names.items()])


def _run(kind: str, **fields):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = cut(order_grid(spark, sf_dir))  # read for extents, targets and operands
        last = cells.groupBy("table_id").agg(F.max("row_index").alias("last"))
        out = edges.evaluate(_specs(spark, kind, last, **fields), cells, [kind])
        return out.select("table_id", "row_index", "col_index", "current_value", F.round("expected_value", 6).alias("expected_value"), "passed")

    return f


years = f"sequence(1, {N})"
query("chk_row_sum", GRID + f"SELECT {OUT.format(tol=1)} FROM (SELECT a.t, a.r, a.c, a.v, sum(o.v) AS e FROM g a JOIN g o ON a.t = o.t AND a.r = o.r AND o.c BETWEEN 1 AND {N} WHERE a.c = {N + 1} GROUP BY ALL)")(
    _run("row_sum", target_column=str(N + 1), operand_columns=years)
)
query("chk_column_sum", GRID + f"SELECT {OUT.format(tol=1)} FROM (SELECT a.t, a.r, a.c, a.v, sum(o.v) AS e FROM g a JOIN g o ON a.t = o.t AND a.c = o.c AND o.r < a.r WHERE a.r = 6 GROUP BY ALL)")(
    _run("column_sum", target_row="last", columns=f"sequence(1, {N + 1})", operand_rows="sequence(1, last - 1)")
)
query("chk_region_total", GRID + f"SELECT {OUT.format(tol=1)} FROM (SELECT a.t, a.r, a.c, a.v, sum(o.v) AS e FROM g a JOIN g o ON a.t = o.t AND a.c = o.c AND o.r BETWEEN 1 AND 3 WHERE a.r = 6 AND a.c <= {N} GROUP BY ALL)")(
    _run("region_total", target_row="last", columns=years, operand_rows="array(1, 2, 3, 99)")
)
query("chk_row_arithmetic", GRID + f"SELECT {OUT.format(tol=1)} FROM (SELECT a.t, a.r, a.c, a.v, x.v - y.v + z.v AS e FROM g a JOIN g x ON a.t = x.t AND a.r = x.r AND x.c = {N + 1} JOIN g y ON a.t = y.t AND a.r = y.r AND y.c = 1 JOIN g z ON a.t = z.t AND a.r = z.r AND z.c = 2 WHERE a.c = 3 AND a.r <> 2)")(
    _run("row_arithmetic", target_column="3", terms=f"array(named_struct('op', '+', 'column', {N + 1}), named_struct('op', '-', 'column', 1), named_struct('op', '+', 'column', 2))", display_only_row_indices="array(2)")
)
query("chk_row_ratio", GRID + f"SELECT {OUT.format(tol=1)} FROM (SELECT a.t, a.r, a.c, a.v, 100.0 * x.v / (y.v + z.v) AS e FROM g a JOIN g x ON a.t = x.t AND a.r = x.r AND x.c = 2 JOIN g y ON a.t = y.t AND a.r = y.r AND y.c = 3 JOIN g z ON a.t = z.t AND a.r = z.r AND z.c = 4 WHERE a.c = 1 AND y.v + z.v <> 0)")(
    _run("row_ratio", target_column="1", numerator_column="2", denominator_columns="array(3, 4)", multiplier="100.0")
)
query("chk_column_share", GRID + f"SELECT {OUT.format(tol=1)} FROM (SELECT a.t, a.r, a.c, a.v, 100.0 * x.v / y.v AS e FROM g a JOIN g x ON a.t = x.t AND a.r = x.r AND x.c = 2 JOIN g y ON a.t = y.t AND y.r = 6 AND y.c = 2 WHERE a.c = 1 AND y.v <> 0)")(
    _run("column_share_ratio", target_column="1", numerator_column="2", denominator_row="last")
)
query("chk_ratio_by_rows", GRID + f"SELECT {OUT.format(tol=1)} FROM (SELECT a.t, a.r, a.c, a.v, x.v / (y.v + z.v) AS e FROM g a JOIN g x ON a.t = x.t AND a.c = x.c AND x.r = 2 JOIN g y ON a.t = y.t AND a.c = y.c AND y.r = 3 JOIN g z ON a.t = z.t AND a.c = z.c AND z.r = 4 WHERE a.r = 1 AND a.c <= {N} AND y.v + z.v <> 0)")(
    _run("row_ratio_by_rows", target_row="1", columns=years, numerator_row="2", denominator_rows="array(3, 4)")
)
CELLS = "array(named_struct('row', 1, 'column', 1, 'op', '{a}'), named_struct('row', 2, 'column', 2, 'op', '{b}'), named_struct('row', {r}, 'column', 1, 'op', '+'))"
query("chk_cell_sum", GRID + f"SELECT {OUT.format(tol=1)} FROM (SELECT a.t, a.r, a.c, a.v, x.v + y.v AS e FROM g a JOIN g x ON a.t = x.t AND x.r = 1 AND x.c = 1 JOIN g y ON a.t = y.t AND y.r = 2 AND y.c = 2 WHERE a.r = 6 AND a.c = 1)")(
    _run("cell_sum", target_row="last", target_column="1", operand_cells=CELLS.format(a="+", b="+", r=99))
)
query("chk_relation_sum", GRID + f"SELECT {OUT.format(tol=1)} FROM (SELECT a.t, a.r, a.c, a.v, x.v - y.v + z.v AS e FROM g a JOIN g x ON a.t = x.t AND x.r = 1 AND x.c = 1 JOIN g y ON a.t = y.t AND y.r = 2 AND y.c = 2 JOIN g z ON a.t = z.t AND z.r = 3 AND z.c = 1 WHERE a.r = 6 AND a.c = 1)")(
    _run("cell_relation_sum", target_row="last", target_column="1", operand_cells=CELLS.format(a="+", b="-", r=3))
)
query("chk_weighted_average", GRID + f"SELECT {OUT.format(tol=0.05)} FROM (SELECT a.t, a.r, a.c, a.v, sum(x.v * w.v) / sum(w.v) AS e FROM g a JOIN g x ON a.t = x.t AND x.c = a.c AND x.r < 6 JOIN g w ON w.t = x.t AND w.r = x.r AND w.c = {N + 1} WHERE a.r = 6 AND a.c <= 3 GROUP BY ALL)")(
    _run("weighted_average", target_row="last", columns="array(1, 2, 3)", operand_rows="sequence(1, last - 1)", weight_column=str(N + 1))
)
query("chk_row_growth", GRID + f"SELECT t AS table_id, r AS row_index, c AS col_index, v AS current_value, round(e, 6) AS expected_value, abs(v - e) <= 0.5 AS passed FROM (SELECT a.t, a.r, a.c, a.v, 100.0 * (x.v - y.v) / y.v AS e FROM g a JOIN g x ON a.t = x.t AND a.r = x.r AND x.c = 2 JOIN g y ON a.t = y.t AND a.r = y.r AND y.c = 1 WHERE a.c = 3 AND y.v <> 0)")(
    _run("row_growth_rate", target_column="3", current_column="2", previous_column="1")
)
PAIRS = "array(named_struct('target_row', 1, 'source_row', 2, 'value_row', null, 'weight_row', null), named_struct('target_row', 3, 'source_row', last, 'value_row', null, 'weight_row', null))"
YOY = f"SELECT {{out}} FROM (SELECT a.t, a.r, a.c, a.v, {{e}} AS e FROM g a JOIN g x ON a.t = x.t AND x.c = a.c AND x.r = CASE a.r WHEN 1 THEN 2 ELSE 6 END JOIN g y ON y.t = x.t AND y.r = x.r AND y.c = a.c - 1 WHERE a.r IN (1, 3) AND a.c BETWEEN 2 AND {N}{{more}})"
query("chk_yoy_rate", GRID + YOY.format(out=OUT.format(tol=0.15), e="100.0 * (x.v - y.v) / y.v", more=" AND y.v <> 0"))(_run("row_year_over_year_rate", columns=years, row_pairs=PAIRS))
query("chk_yoy_amount", GRID + YOY.format(out=OUT.format(tol=1), e="x.v - y.v", more=""))(_run("row_year_over_year_change_amount", columns=years, row_pairs=PAIRS))
query(
    "chk_year_rows_rate",
    GRID + "SELECT t AS table_id, r AS row_index, c AS col_index, v AS current_value, round(e, 6) AS expected_value, abs(v - e) <= CASE c WHEN 3 THEN 0.15 ELSE 1 END AS passed FROM (SELECT a.t, a.r, a.c, a.v, CASE a.c WHEN 3 THEN 100.0 * (x.v - y.v) / y.v ELSE x.v - y.v END AS e FROM g a JOIN g x ON a.t = x.t AND x.r = a.r AND x.c = 1 JOIN g y ON y.t = x.t AND y.r = a.r - 1 AND y.c = 1 WHERE a.r BETWEEN 2 AND 5 AND a.c IN (2, 3) AND y.v <> 0)",
)(_run("year_rows_change_rate", row_indices="sequence(1, last - 1)", value_column="1", change_column="2", rate_column="3"))
query("chk_year_rows_amount", GRID + f"SELECT {OUT.format(tol=1)} FROM (SELECT a.t, a.r, a.c, a.v, x.v - y.v AS e FROM g a JOIN g x ON a.t = x.t AND x.r = a.r AND x.c = 1 JOIN g y ON y.t = x.t AND y.r = a.r - 1 AND y.c = 1 WHERE a.r BETWEEN 2 AND 5 AND a.c = 2)")(
    _run("year_rows_change_amount", row_indices="sequence(1, last - 1)", value_column="1", change_column="2")
)
OTHER = "table_id % 5 + 1"
query("xtb_row_sum", GRID + f"SELECT {OUT.format(tol=1)} FROM (SELECT a.t, a.r, a.c, a.v, x.v + y.v AS e FROM g a JOIN g x ON a.t = x.t AND a.r = x.r AND x.c = 2 JOIN g y ON y.t = a.t % 5 + 1 AND y.r = 6 AND y.c = 3 WHERE a.c = 1 AND a.r = 6)")(
    _run("cross_table_row_sum", target_column="1", operand_columns="array(2)", source_table_id=OTHER, source_column="3")
)
query("xtb_cell_match", GRID + f"SELECT {OUT.format(tol=1)} FROM (SELECT a.t, a.r, a.c, a.v, y.v AS e FROM g a JOIN g y ON y.t = a.t % 5 + 1 AND y.r = 1 AND y.c = 1 WHERE a.c = 1 AND a.r = 2)")(
    _run("cross_table_cell_match", target_row="2", target_column="1", source_table_id=OTHER, source_row="1", source_column="1")
)
query("xtb_weighted_average", GRID + f"SELECT {OUT.format(tol=1)} FROM (SELECT a.t, a.r, a.c, a.v, sum(x.v * w.v) / sum(w.v) AS e FROM g a JOIN g x ON x.t = a.t % 5 + 1 AND x.c = 1 AND x.r IN (1, 2) JOIN g w ON w.t = x.t AND w.r = x.r AND w.c = 2 WHERE a.c = 1 AND a.r = 6 GROUP BY ALL)")(
    _run("cross_table_weighted_average", target_row="last", target_column="1", source_table_id=OTHER, source_column="1", source_weight_column="2", row_pairs="array(named_struct('target_row', null, 'source_row', null, 'value_row', 1, 'weight_row', 1), named_struct('target_row', null, 'source_row', null, 'value_row', 2, 'weight_row', 2))")
)


@query("grid_cells", GRID + "SELECT t AS table_id, r AS row_index, c AS col_index, v AS numeric_value FROM g")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_grid(spark, sf_dir).where("row_index > 0 and col_index > 0").select("table_id", "row_index", "col_index", "numeric_value")


@query("grid_highlights", GRID + f"SELECT t AS table_id, 6 AS target_row, c AS target_col, 6 AS n_cells FROM g WHERE r = 6 AND c <= {N}")
def grid_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_grid(spark, sf_dir)
    last = cells.groupBy("table_id").agg(F.max("row_index").alias("last"))
    out = edges.highlights(_specs(spark, "column_sum", last, target_row="last", columns=years, operand_rows="sequence(1, last - 1)"), cells, ["column_sum"])
    return out.select("table_id", "target_row", "target_col", F.size("cells").alias("n_cells"))


@query("grid_highlight_cells", GRID + f"SELECT a.t AS table_id, a.c AS target_col, o.r AS row, o.c AS col, CASE WHEN o.r = a.r THEN 'target' ELSE 'related' END AS role FROM g a JOIN g o ON o.t = a.t AND o.c = a.c AND o.r <= a.r WHERE a.r = 6 AND a.c <= {N}")
def grid_highlight_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells themselves that a column's sum marks."""
    cells = order_grid(spark, sf_dir)
    last = cells.groupBy("table_id").agg(F.max("row_index").alias("last"))
    out = edges.highlights(_specs(spark, "column_sum", last, target_row="last", columns=years, operand_rows="sequence(1, last - 1)"), cells, ["column_sum"])
    return out.select("table_id", "target_col", F.explode("cells").alias("h")).select("table_id", "target_col", "h.*")


def _order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cut(order_grid(spark, sf_dir))
    last = cells.groupBy("table_id").agg(F.max("row_index").alias("last"))
    specs = _specs(spark, "row_sum", last, target_column=str(N + 1), operand_columns=years).unionAll(_specs(spark, "column_sum", last, target_row="last", columns=f"sequence(1, {N + 1})", operand_rows="sequence(1, last - 1)"))
    return edges.evaluate(specs, cells, ["row_sum", "column_sum"])


BOTH = (
    GRID
    + f""", checks AS (
SELECT t, r, c, 'row_sum' AS kind, abs(v - e) <= 1 AS passed, v, e FROM (SELECT a.t, a.r, a.c, a.v, sum(o.v) AS e FROM g a JOIN g o ON a.t = o.t AND a.r = o.r AND o.c BETWEEN 1 AND {N} WHERE a.c = {N + 1} GROUP BY ALL)
UNION ALL SELECT t, r, c, 'column_sum', abs(v - e) <= 1, v, e FROM (SELECT a.t, a.r, a.c, a.v, sum(o.v) AS e FROM g a JOIN g o ON a.t = o.t AND a.c = o.c AND o.r < a.r WHERE a.r = 6 GROUP BY ALL))
"""
)


@query("report_summary", BOTH + "SELECT count(*) AS checks, count(*) FILTER (WHERE passed) AS normal, count(*) FILTER (WHERE NOT passed) AS suspect, count(DISTINCT t) AS tables FROM checks")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summary(_order_checks(spark, sf_dir))


@query("status_rollup", BOTH + "SELECT t AS table_id, CASE WHEN bool_and(passed) THEN '정상' ELSE '오류 의심' END AS status, count(*) FILTER (WHERE NOT passed) AS issues FROM checks GROUP BY t")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.rollup(_order_checks(spark, sf_dir))


@query("issue_counts", BOTH + "SELECT kind AS type, count(*) AS issues FROM checks WHERE NOT passed GROUP BY kind")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.issue_counts(_order_checks(spark, sf_dir))


@query("issue_dedupe", BOTH + "SELECT t AS table_id, r AS row_index, c AS col_index, min(kind) AS type FROM checks WHERE NOT passed GROUP BY t, r, c, v")
def issue_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _order_checks(spark, sf_dir)
    twice = checks.unionAll(checks)
    return findings.dedupe_issues(twice, ["table_id", "row_index", "col_index", "current_value"], ["type"]).select("table_id", "row_index", "col_index", "type")


@query("check_evidence", BOTH + "SELECT t AS table_id, r AS row_index, c AS col_index, CASE WHEN passed THEN NULL ELSE round(v - e, 6) END AS difference, CASE WHEN passed THEN 'info' ELSE 'critical' END AS severity FROM checks WHERE kind = 'column_sum'")
def check_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_checks(spark, sf_dir).where("type = 'column_sum'").select("table_id", "row_index", "col_index", F.round("difference", 6).alias("difference"), "severity")


@query(
    "xtb_adjacent_duplicate",
    GRID + "SELECT a.t AS table_id, a.t - 1 AS previous_id, round(avg(CASE WHEN a.v = b.v THEN 1.0 ELSE 0.0 END), 6) AS similarity FROM g a JOIN g b ON b.t = a.t - 1 AND a.r = b.r AND a.c = b.c GROUP BY a.t",
)
def xtb_adjacent_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_grid(spark, sf_dir).where("row_index > 0 and col_index > 0")
    order = cells.select("table_id").distinct().select("table_id", F.lit("orders").alias("parent"), F.col("table_id").alias("table_order"))
    return crosstable.adjacent_similarity(cells, order).select("table_id", "previous_id", F.round("similarity", 6).alias("similarity"))


@query(
    "xtb_split_part_total",
    GRID + f"SELECT r AS row_index, c AS col_index, v AS current_value, e AS expected_value, abs(v - e) <= 1 AS passed FROM (SELECT a.r, a.c, a.v, sum(o.v) AS e FROM g a JOIN g o ON o.r = a.r AND o.c BETWEEN 1 AND {N} AND o.t IN (1, 2) WHERE a.t = 1 AND a.c = {N + 1} GROUP BY ALL)",
)
def xtb_split_part_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables 1 and 2 as parts of one table: part 1's total against the details of all parts, rows matched by position label."""
    cells = order_grid(spark, sf_dir).where("table_id in (1, 2)")
    cells = cells.withColumn("text_value", F.when((F.col("col_index") == 0) & ~F.col("is_header"), F.concat(F.lit("행"), F.col("row_index").cast("string"))).otherwise(F.col("text_value")))
    parts = cells.select("table_id").distinct().select("table_id", F.lit("p").alias("base_code"), F.col("table_id").cast("int").alias("part"))
    return crosstable.split_part_totals(cells, parts, least_passed=0.0).select("row_index", "col_index", "current_value", "expected_value", "passed")
