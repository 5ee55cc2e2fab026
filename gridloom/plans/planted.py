"""Queries of checks over all grids of the yearbook, each with a planted total row and column of which some are off by 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions.grid import deduplicated
from gridloom.operators import crosstable, edges, findings, report
from gridloom.plans.checks import _specs
from gridloom.plans.grids import CELLS, NORMAL, cells_of, parse_sql
from gridloom.plans.registry import query
from gridloom.plans.scalars import TOTAL_SQL, D
from gridloom.session import cut, table

OFF = 5


def planted(spark: SparkSession, sf_dir: str, off: int = OFF) -> tuple[DataFrame, DataFrame]:
    """(cells, shape): rows with numbers, made full with blanks, their total in column `width`, the columns' totals in row `last`."""
    c = cells_of(spark, sf_dir)
    v = c.where("not is_header and col_index > 0").select("table_id", "row_index", "col_index", N.raw_value(F.col("numeric_value"), F.col("text_value")).alias("v")).where("v is not null")
    shape = cut(c.groupBy("table_id").agg((F.max("col_index") + 1).alias("width"), (F.max("row_index") + 1).alias("last"), (F.coalesce(F.max(F.when(F.col("is_header"), F.col("row_index"))), F.lit(0))).alias("head")).join(v.select("table_id").distinct(), "table_id"))
    v = v.join(shape, "table_id")
    wrong = lambda when: F.when(when % 11 == 0, off).otherwise(0)
    rows = v.groupBy("table_id", "row_index", "width").agg(F.sum("v").alias("v"))
    full = rows.select("table_id", "row_index", F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("col_index")).join(v.select("table_id", "row_index", "col_index", "v"), ["table_id", "row_index", "col_index"], "left")
    right = rows.select("table_id", "row_index", F.col("width").alias("col_index"), (F.col("v") + wrong(F.col("table_id") * 7 + F.col("row_index") * 3)).alias("v"))
    below = v.groupBy("table_id", "last", "col_index").agg(F.sum("v").alias("v")).select("table_id", F.col("last").alias("row_index"), "col_index", (F.col("v") + wrong(F.col("table_id") + F.col("col_index"))).alias("v"))
    number = lambda df: df.select("table_id", "row_index", "col_index", F.when(F.col("v").isNull(), "").alias("text_value"), F.col("v").alias("numeric_value"), F.lit(False).alias("is_header"))
    label = lambda df, text, head: df.select("table_id", "row_index", "col_index", text.alias("text_value"), F.lit(None).cast("double").alias("numeric_value"), F.lit(head).alias("is_header"))
    heads = label(c.where("is_header").join(shape, "table_id"), F.col("text_value"), True).unionAll(label(shape.select("table_id", F.col("head").alias("row_index"), F.col("width").alias("col_index")), F.lit("합계\nTotal"), True))
    names = label(c.where("not is_header and col_index = 0").join(rows.select("table_id", "row_index"), ["table_id", "row_index"]), F.col("text_value"), False).unionAll(label(shape.select("table_id", F.col("last").alias("row_index"), F.lit(0).alias("col_index")), F.lit("합계 Total"), False))
    return number(full).unionAll(number(right)).unionAll(number(below)).unionAll(heads).unionAll(names), shape


GRIDS = f"""WITH {CELLS}, v AS (SELECT table_id, row_index AS r, col_index AS c, coalesce(numeric_value, {parse_sql('text_value')}) AS v FROM cells WHERE NOT is_header AND col_index > 0 AND coalesce(numeric_value, {parse_sql('text_value')}) IS NOT NULL),
shape AS (SELECT table_id, max(col_index) + 1 AS w, max(row_index) + 1 AS last FROM cells GROUP BY table_id),
rows AS (SELECT table_id, r, w AS c, (table_id * 7 + r * 3) % 11 = 0 AS bad FROM v JOIN shape USING (table_id) GROUP BY ALL),
cols AS (SELECT table_id, last AS r, c, (table_id + c) % 11 = 0 AS bad, count(*) AS n FROM v JOIN shape USING (table_id) GROUP BY ALL)
"""


def _sums(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    cells, shape = planted(spark, sf_dir)
    cells = cut(cells)
    fields = {"row_sum": {"target_column": "width", "operand_columns": "sequence(1, width - 1)", "row_indices": "sequence(head + 1, last - 1)"}, "column_sum": {"target_row": "last", "columns": "sequence(1, width - 1)", "operand_rows": "sequence(head + 1, last - 1)"}}
    return edges.evaluate(_specs(spark, kind, shape.where("last > head + 1"), **fields[kind]), cells, [kind])


@query("chk_planted_rows", GRIDS + f"SELECT table_id, r AS row_index, c AS col_index, NOT bad AS passed, CASE WHEN bad THEN {OFF}.0 END AS difference FROM rows")
def chk_planted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(spark, sf_dir, "row_sum").select("table_id", "row_index", "col_index", "passed", F.round("difference", 1).alias("difference"))


@query("chk_planted_columns", GRIDS + f", rs AS (SELECT table_id, count(DISTINCT r) AS n_rows FROM v GROUP BY table_id) SELECT table_id, r AS row_index, c AS col_index, NOT bad AS passed, CASE WHEN bad THEN {OFF}.0 END AS difference FROM cols JOIN rs USING (table_id) WHERE n_rows >= 2")
def chk_planted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(spark, sf_dir, "column_sum").select("table_id", "row_index", "col_index", "passed", F.round("difference", 1).alias("difference"))


@query("report_list", GRIDS + "SELECT a.id AS report_id, a.year, coalesce(t.n, 0) AS tables, coalesce(k.n, 0) AS checks, coalesce(k.bad, 0) AS issues, coalesce(k.bad, 0) AS suspects FROM annual_reports a LEFT JOIN (SELECT report_id, count(*) AS n FROM stat_tables GROUP BY 1) t ON t.report_id = a.id LEFT JOIN (SELECT report_id, count(*) AS n, count(*) FILTER (WHERE bad) AS bad FROM rows JOIN stat_tables s ON s.id = rows.table_id GROUP BY 1) k ON k.report_id = a.id")
def report_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_list(table(spark, sf_dir, "annual_reports"), table(spark, sf_dir, "stat_tables"), _sums(spark, sf_dir, "row_sum"))


@query("report_groups", GRIDS + """, g AS (SELECT s.domain AS "group", bad FROM rows JOIN stat_tables s ON s.id = rows.table_id) SELECT "group", CASE WHEN bool_or(bad) THEN '오류 의심' ELSE '정상' END AS status, count(*) FILTER (WHERE bad) AS issues, coalesce('row_sum=' || nullif(count(*) FILTER (WHERE bad), 0), '') AS counts FROM g GROUP BY ALL""")
def report_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "stat_tables").select(F.col("id").alias("table_id"), F.col("domain").alias("group"))
    out = findings.group_rollup(_sums(spark, sf_dir, "row_sum"), groups)
    return out.select("group", "status", "issues", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("report_visible", GRIDS + ", b AS (SELECT table_id, count(*) FILTER (WHERE bad) AS n FROM rows GROUP BY 1) SELECT s.id AS table_id, CASE WHEN coalesce(b.n, 0) > 0 THEN '오류 의심' ELSE '정상' END AS status, coalesce(b.n, 0) AS issues FROM stat_tables s LEFT JOIN b ON b.table_id = s.id")
def report_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of every table without the hidden outliers, of which every check is doubled as one here."""
    checks = _sums(spark, sf_dir, "row_sum")
    return findings.visible(checks.unionAll(checks.withColumns({"type": F.lit("outlier_columns"), "passed": F.lit(False)})), table(spark, sf_dir, "stat_tables").select(F.col("id").alias("table_id")))


@query("report_order", GRIDS + "SELECT table_id, r AS row_index, row_number() OVER (PARTITION BY table_id ORDER BY NOT bad, r) AS place FROM rows")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranked(_sums(spark, sf_dir, "row_sum")).select("table_id", "row_index", "place")


@query("report_scopes", GRIDS + ", x AS (SELECT table_id, r, (table_id + r) % 5 AS k FROM rows), h AS (SELECT table_id, coalesce(max(CASE WHEN is_header THEN row_index END) + 1, 1) AS n FROM cells GROUP BY 1) SELECT table_id, r AS row_index, CASE WHEN k = 3 THEN 'metadata' WHEN k = 4 THEN 'none' WHEN r < n THEN 'header' WHEN k = 0 THEN 'row' WHEN k = 1 THEN 'column' ELSE 'cell' END AS scope FROM x JOIN h USING (table_id)")
def report_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of five kinds: of rows, columns, cells and metadata, and one without spec and column."""
    c = _sums(spark, sf_dir, "row_sum").join(cells_of(spark, sf_dir).groupBy("table_id").agg(F.coalesce(F.max(F.when(F.col("is_header"), F.col("row_index"))) + 1, F.lit(1)).alias("n")), "table_id")
    k = (F.col("table_id") + F.col("row_index")) % 5
    kind = F.when(k == 0, "row_sum").when(k == 1, "column_sum").when(k == 2, "outlier_columns").when(k == 3, "metadata_required")
    return c.select("table_id", "row_index", report.scope(kind, F.col("row_index"), F.when(k != 4, F.col("col_index")), F.col("n")).alias("scope"))


@query("report_display_groups", GRIDS + ", x AS (SELECT table_id, r, bad, CASE WHEN r % 3 = 0 THEN 'b' ELSE 'a' END AS k FROM rows) SELECT table_id, CASE WHEN bad THEN '오류 의심' ELSE '정상' END AS status, CASE k WHEN 'a' THEN '합계 검수' ELSE '오탈자 검수' END AS type, CASE WHEN k = 'a' THEN count(*) WHEN bad THEN 1 ELSE count(*) END AS checks FROM x GROUP BY table_id, bad, k, CASE WHEN k = 'b' AND bad THEN r END")
def report_display_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of one formula are one group a status; passed language checks are one, failed ones each their own."""
    c = _sums(spark, sf_dir, "row_sum").withColumns({"type": F.when(F.col("row_index") % 3 == 0, "오탈자 검수").otherwise("합계 검수"), "formula": F.lit("a+b"), "rule_id": F.col("spec_id"), "location": F.lit(""), "detail": F.lit("")})
    return report.display_groups(c).select("table_id", "status", "type", "checks")


@query("report_calculation_order", GRIDS + ", n AS (SELECT table_id, count(DISTINCT c) AS n FROM v GROUP BY 1), x AS (SELECT table_id, 1 AS k, last AS row, w AS col FROM shape JOIN n USING (table_id) WHERE w > 2) SELECT table_id, row, col, CAST(1 AS INT) AS place FROM x")
def report_calculation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check of each table: the grand total, as the columns' totals go into it, and the rows' totals into none before it."""
    _, shape = planted(spark, sf_dir)
    shape = shape.where("width > 2")
    related = lambda r, c: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"), F.lit("related").alias("role"))
    grand = shape.select(F.concat(F.lit("z"), "table_id").alias("spec_id"), "table_id", F.col("last").alias("target_row"), F.col("width").alias("target_col"), F.transform(F.sequence(F.lit(1), F.col("width") - 1), lambda c: related(F.col("last"), c)).alias("cells"))
    columns = shape.select(F.concat(F.lit("a"), "table_id").alias("spec_id"), "table_id", F.col("last").alias("target_row"), F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("target_col"), F.array(related(F.lit(0), F.lit(0))).alias("cells"))
    both = grand.unionAll(columns)
    out = report.calculation_order(both, both.select("spec_id").distinct().withColumn("type", F.lit("합계 검수")))
    return out.where("place = 1").select("table_id", "row", "col", "place")


@query("report_order_of_reports", "SELECT id, CAST(row_number() OVER (ORDER BY year DESC, imported_at DESC NULLS LAST, id DESC) AS INT) AS place FROM annual_reports")
def report_order_of_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.listed_reports(table(spark, sf_dir, "annual_reports")).select("id", "place")


@query("report_search", GRIDS + ", b AS (SELECT DISTINCT table_id FROM rows WHERE bad) SELECT id FROM stat_tables WHERE contains(lower(concat_ws(' ', title, title_en, code)), 'trend of') AND id IN (SELECT table_id FROM b)")
def report_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.search(table(spark, sf_dir, "stat_tables"), " Trend OF ", findings.rollup(_sums(spark, sf_dir, "row_sum")), "오류 의심").select("id")


@query("report_display_rows", f"WITH {CELLS} SELECT table_id, row_index, max(CASE WHEN col_index = 0 THEN {D('text_value')} END) AS label, count(*) AS n, count(*) FILTER (WHERE footnote_marker <> '') AS marks, string_agg(CASE WHEN {D('text_value')} <> '' OR numeric_value IS NULL THEN {D('text_value')} WHEN numeric_value = floor(numeric_value) THEN format('{{:,}}', CAST(numeric_value AS BIGINT)) ELSE format('{{:,.1f}}', numeric_value) END, '|' ORDER BY col_index) AS line FROM cells WHERE NOT is_header GROUP BY ALL")
def report_display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = report.display_rows(deduplicated(table(spark, sf_dir, "stat_table_cells")))
    return r.select("table_id", "row_index", "label", F.size("cells").cast("long").alias("n"), F.size("footnotes").cast("long").alias("marks"), F.array_join(F.map_values("cells"), "|").alias("line"))


@query("report_key_figures", f"""WITH {CELLS}, k AS (SELECT table_id, row_index FROM (SELECT table_id, row_index, {D('text_value')} AS d FROM cells WHERE NOT is_header AND col_index = 0) WHERE ({TOTAL_SQL}) IS NOT NULL),
v AS (SELECT table_id, row_index, col_index, coalesce(numeric_value, {parse_sql('text_value')}) AS v FROM cells WHERE NOT is_header AND col_index > 0), w AS (SELECT * FROM v WHERE v IS NOT NULL),
m AS (SELECT *, dense_rank() OVER (PARTITION BY table_id ORDER BY col_index) AS metric FROM w)
SELECT table_id, metric, col_index, row_index, v AS value, row_number() OVER (PARTITION BY table_id, metric ORDER BY v DESC, row_index) AS rank FROM m WHERE metric <= 3 AND NOT EXISTS (SELECT 1 FROM k WHERE k.table_id = m.table_id AND k.row_index = m.row_index) QUALIFY rank <= 8""")
def report_key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.key_figures(cells_of(spark, sf_dir))


@query("report_issue_places", f"""WITH {CELLS}, i AS (SELECT id AS issue_id, table_id, lower(regexp_replace(text_value, '\\s+', '', 'g')) AS f FROM cells WHERE col_index = 0 AND id % 3 = 0 AND text_value IS NOT NULL),
c AS (SELECT table_id, row_index, col_index, lower(regexp_replace(text_value, '\\s+', '', 'g')) AS t FROM cells WHERE text_value IS NOT NULL)
SELECT issue_id, row_index, col_index FROM i JOIN c ON c.table_id = i.table_id AND contains(t, f) AND t <> '' AND f <> '' QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY t <> f, row_index, col_index) = 1""".replace("\\\\", "\\").replace(r"'\s+'", "'[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"))
def report_issue_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cut(deduplicated(table(spark, sf_dir, "stat_table_cells").select("id", "table_id", "row_index", "col_index", "text_value")))
    i = c.where("col_index = 0 and id % 3 = 0 and text_value is not null").select(F.col("id").alias("issue_id"), "table_id", F.col("text_value").alias("found"))
    return report.issue_places(i, c).where("row_index is not null").select("issue_id", "row_index", "col_index")


@query("report_decisions", "SELECT coalesce(department, '?') AS decision, count(*) AS n FROM reference_owners GROUP BY ALL UNION ALL SELECT 'all', count(*) FROM reference_owners")
def report_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.decision_counts(table(spark, sf_dir, "reference_owners").select(F.coalesce("department", F.lit("?")).alias("decision")), "decision")


@query("report_specs", "SELECT id, 'row_sum' AS spec_type, CASE WHEN id % 2 = 0 THEN 'own' ELSE 'base' END AS how FROM stat_tables WHERE id % 3 <> 0")
def report_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule ids that name a spec, a part of one, or none."""
    t = table(spark, sf_dir, "stat_tables").select("id", F.concat(F.lit("row_sum:"), F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).otherwise("none"), F.when(F.col("id") % 2 == 1, ":part").otherwise("")).alias("rule_id"))
    specs = table(spark, sf_dir, "stat_tables").select(F.concat(F.lit("row_sum:"), "id").alias("spec_id"), F.lit("row_sum").alias("type"), F.lit("x").alias("label"))
    return report.with_specs(t, specs).where("spec_type is not null").select("id", "spec_type", F.when(F.col("rule_id").endswith(":part"), "base").otherwise("own").alias("how"))


GROWTH = "c.col_index = 2 AND c.table_id % 3 = 0"


@query("chk_growth_specs", f"WITH {CELLS} SELECT table_id, count(*) AS labels, table_id % 2 = 0 AS passed FROM cells c WHERE is_header AND {GROWTH} GROUP BY table_id")
def chk_growth_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids whose third column is headed as a growth rate; every second table has a spec for it."""
    c = cells_of(spark, sf_dir)
    c = c.withColumn("text_value", F.when(F.col("is_header") & (F.col("col_index") == 2) & (F.col("table_id") % 3 == 0), "감소율(%)\nRate").otherwise(F.col("text_value")))
    specs = c.where("table_id % 2 = 0").select("table_id").distinct().withColumn("type", F.lit("row_growth_rate"))
    return edges.growth_scan(c, specs)


@query("chk_selected_rows", f"""WITH {CELLS}, l AS (SELECT table_id, row_index, regexp_replace(coalesce(CASE WHEN col_index = 0 THEN text_value END, ''), '\\s+', '', 'g') AS k, CASE WHEN col_index > 0 THEN coalesce(numeric_value, {parse_sql('text_value')}) END AS v FROM cells WHERE NOT is_header),
y AS (SELECT *, TRY_CAST(nullif(regexp_extract(k, '^[’'']?((?:19|20)\\d{{2}})년?$', 1), '') AS INT) AS y FROM l)
SELECT table_id, CASE WHEN max(y) IS NOT NULL THEN max(CASE WHEN y IS NOT NULL THEN y * 1000000 + row_index END) % 1000000 END AS latest_year, min(CASE WHEN regexp_matches(k, '^(누적|누계)(총|합)?계?$') THEN row_index END) AS cumulative_total, max(CASE WHEN v IS NOT NULL THEN row_index END) AS latest_data_row FROM y GROUP BY table_id""".replace("\\\\", "\\"))
def chk_selected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.selected_rows(cells_of(spark, sf_dir))


@query("chk_latest_match", GRIDS + ", l AS (SELECT table_id, max(r) AS r FROM v GROUP BY 1) SELECT l.table_id, l.r AS row_index, w AS col_index, NOT ((l.table_id * 7 + l.r * 3) % 11 = 0) AS passed FROM l JOIN shape USING (table_id)")
def chk_latest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of each grid's latest data row against the right one in a second grid, both rows given by selectors."""
    cells, shape = planted(spark, sf_dir)
    good, _ = planted(spark, sf_dir, off=0)
    keep = lambda df: df.join(shape.select("table_id", "last"), "table_id").where("row_index < last").drop("last")
    cells = cut(keep(cells).unionAll(keep(good).withColumn("table_id", F.col("table_id") + 10_000_000)))
    specs = _specs(spark, "cross_table_cell_match", shape, target_column="width", source_column="width", source_table_id="table_id + 10000000", tolerance="1.0")
    slots = specs.select("spec_id", F.explode(F.array(F.lit("target_row"), F.lit("source_row"))).alias("slot")).select("spec_id", "slot", F.lit("latest_data_row").alias("selector"), F.lit(None).cast("int").alias("column"), F.lit("+").alias("op"))
    return edges.evaluate(edges.resolved(specs, cells, slots), cells, ["cross_table_cell_match"]).select("table_id", "row_index", "col_index", "passed")


@query("chk_source_columns", GRIDS + "SELECT r.table_id, r.r AS row_index, r.c AS col_index, TRUE AS passed FROM rows r JOIN shape USING (table_id)")
def chk_source_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right total of every row against all columns of a second grid, whose rows are found by label (here: their place)."""
    cells, shape = planted(spark, sf_dir, off=0)
    cells = cells.join(shape.select("table_id", "last"), "table_id").where("row_index < last and not is_header and col_index > 0").drop("last")
    name = cells.select("table_id", "row_index").distinct().select("table_id", "row_index", F.lit(0).alias("col_index"), F.concat(F.lit("행"), F.col("row_index").cast("string")).alias("text_value"), F.lit(None).cast("double").alias("numeric_value"), F.lit(False).alias("is_header"))
    both = cells.unionByName(name)
    both = cut(both.unionAll(both.withColumn("table_id", F.col("table_id") + 10_000_000)))
    specs = _specs(spark, "cross_table_row_sum", shape, target_column="width", operand_columns="cast(array() as array<int>)", source_table_id="table_id + 10000000", source_columns="sequence(1, width - 1)", row_indices="sequence(head + 1, last - 1)")
    checks = cut(edges.evaluate(specs, both, ["cross_table_row_sum"]))
    again = edges.source_checks(checks, specs, both).groupBy("spec_id", "row_index").agg(F.min("passed").alias("at_source"))
    return checks.join(again, ["spec_id", "row_index"]).select("table_id", "row_index", "col_index", (F.col("passed") & F.col("at_source")).alias("passed"))


@query("chk_skipped", "SELECT DISTINCT n_regionkey + 1 AS table_id, 2 AS row_index FROM nation")
def chk_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display-only row of row_arithmetic, as a passed check of its own."""
    from gridloom.plans.checks import order_grid

    cells = cut(order_grid(spark, sf_dir))
    specs = _specs(spark, "row_arithmetic", cells.select("table_id").distinct(), target_column="3", terms="array(named_struct('op', '+', 'column', 1))", display_only_row_indices="array(2)")
    return edges.skipped(specs, cells, edges.evaluate(specs, cells, ["row_arithmetic"])).select("table_id", "row_index")


@query("chk_outlier_report", f"""WITH {CELLS}, k AS (SELECT table_id, row_index FROM (SELECT table_id, row_index, {D('text_value')} AS d FROM cells WHERE NOT is_header AND col_index = 0) WHERE ({TOTAL_SQL}) IS NOT NULL),
v AS (SELECT c.table_id, c.row_index, col_index, coalesce(numeric_value, {parse_sql('text_value')}) AS x FROM cells c LEFT JOIN k ON k.table_id = c.table_id AND k.row_index = c.row_index WHERE NOT is_header AND col_index > 0 AND k.table_id IS NULL),
m AS (SELECT table_id, col_index, median(x) AS med FROM v WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) >= 5),
d AS (SELECT v.*, abs(x - med) AS dev FROM v JOIN m USING (table_id, col_index) WHERE x IS NOT NULL), a AS (SELECT table_id, col_index, median(dev) AS mad FROM d GROUP BY ALL HAVING median(dev) <> 0),
f AS (SELECT table_id, row_index, col_index, round(dev / mad, 4) AS score, FALSE AS passed FROM d JOIN a USING (table_id, col_index) WHERE dev / mad > 20 QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY dev / mad DESC, row_index DESC, col_index DESC) <= 5)
SELECT * FROM f UNION ALL SELECT table_id, NULL, NULL, NULL, TRUE FROM (SELECT DISTINCT table_id FROM v WHERE x IS NOT NULL) WHERE table_id NOT IN (SELECT table_id FROM f)""")
def chk_outlier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.outlier_checks(cells_of(spark, sf_dir)).withColumn("score", F.round("score", 4))


COPIES = f"""WITH {CELLS}, t AS (SELECT id, report_id, code, title, regexp_replace(regexp_replace(code, '\\s+표\\s*[0-9]+$', ''), '-[^-]*$', '') AS parent, table_order, note FROM stat_tables),
d AS (SELECT id + 1000000 AS table_id, id AS previous_id, code, note FROM t WHERE id % 10 = 0)""".replace("\\\\", "\\")


def _with_copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cells, tables): every tenth table once more right behind itself, under another title and code."""
    t = table(spark, sf_dir, "stat_tables").select(F.col("id").alias("table_id"), "report_id", "code", "title", "note", (F.col("table_order").cast("long") * 10**9 + F.col("id") * 2).alias("table_order"))
    t = t.withColumn("parent", F.concat_ws("|", "report_id", crosstable.parent_code(F.col("code"))))
    copy = t.where("table_id % 10 = 0").withColumns({"table_id": F.col("table_id") + 1_000_000, "title": F.concat("title", F.lit(" 사본")), "code": F.concat(F.lit("99-"), crosstable.base_code(F.col("code"))), "table_order": F.col("table_order") + 1})
    c = cells_of(spark, sf_dir).select("table_id", "row_index", "col_index", "text_value")
    return c.unionAll(c.where("table_id % 10 = 0").withColumn("table_id", F.col("table_id") + 1_000_000)), t.unionAll(copy)


@query("xtb_duplicates", COPIES + " SELECT table_id, previous_id, 1.0 AS similarity FROM d WHERE previous_id IN (SELECT table_id FROM cells)")
def xtb_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = _with_copies(spark, sf_dir)
    return crosstable.adjacent_duplicates(c, t).where("table_id > 1000000")


@query("xtb_anomaly_notes", COPIES + " SELECT table_id AS id, CASE WHEN coalesce(note, '') = '' THEN '' ELSE note || chr(10) END || '[확인 필요] ' || code || ' 표와 같은 값' AS note FROM d WHERE previous_id IN (SELECT table_id FROM cells)")
def xtb_anomaly_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = _with_copies(spark, sf_dir)
    out = crosstable.with_anomaly_notes(t.withColumnRenamed("table_id", "id"), crosstable.adjacent_duplicates(c, t).where("table_id > 1000000"))
    return out.where("id > 1000000 and note like '%[확인 필요]%'").select("id", "note")


@query("xtb_rebuilt_specs", "SELECT id, CASE WHEN id % 4 <> 3 THEN 'split_part_row_total' END AS type, CASE WHEN id % 4 <> 3 THEN CAST(id AS VARCHAR) END AS target, CASE WHEN id % 4 <> 3 THEN '2,3' END AS rows FROM stat_tables")
def xtb_rebuilt_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.concat(F.when(F.col("id") % 4 == 3, "other.").otherwise("cross."), F.lit("split_part_row_total:role=target:target="), F.col("id").cast("string"), F.lit(":rows=2,3"))
    m = crosstable.rebuilt_spec(rule)
    return table(spark, sf_dir, "stat_tables").select("id", m["type"].alias("type"), m["target"].alias("target"), m["rows"].alias("rows"))


PARTS = GRIDS + ", n AS (SELECT table_id, count(*) AS n, avg(CASE WHEN bad THEN 0.0 ELSE 1.0 END) AS good FROM rows JOIN shape USING (table_id) WHERE w > 3 GROUP BY 1 HAVING count(*) >= 5 AND avg(CASE WHEN bad THEN 0.0 ELSE 1.0 END) >= 0.6)"


def _parts(spark: SparkSession, sf_dir: str, metrics: int) -> DataFrame:
    """Each grid in two parts, its total and first column in one, the rest in the other; of so many metrics, the second's values twice as large."""
    cells, shape = planted(spark, sf_dir)
    c = cells.join(shape.where("width > 3"), "table_id").where("not is_header and row_index < last and col_index > 0").select("table_id", "row_index", "col_index", "width", "text_value", "numeric_value")
    c = c.withColumn("metric", F.explode(F.sequence(F.lit(1), F.lit(metrics)))).withColumn("numeric_value", F.col("numeric_value") * F.col("metric"))
    second = (F.col("col_index") > 1) & (F.col("col_index") < F.col("width"))
    c = c.withColumn("of", F.when(second, F.col("table_id") + 10_000_000).otherwise(F.col("table_id"))).withColumn("col", F.col("col_index") * metrics + F.col("metric") - metrics)
    names = F.when(F.col("col_index") == F.col("width"), "합계 Total").otherwise(F.concat(F.lit("항목"), F.col("col_index").cast("string")))
    rows = c.select(F.col("of").alias("table_id"), (F.col("row_index") + 2).alias("row_index"), F.col("col").alias("col_index"), "text_value", "numeric_value", F.lit(False).alias("is_header"))
    head = c.select("of", "col", names.alias("name"), "metric").distinct()
    levels = [F.struct(F.lit(0).alias("r"), F.col("name").alias("t"))] + ([F.struct(F.lit(1).alias("r"), F.concat(F.lit("지표"), F.col("metric").cast("string")).alias("t"))] if metrics > 1 else [])
    heads = head.select("of", "col", F.explode(F.array(*levels)).alias("h")).select(F.col("of").alias("table_id"), F.col("h.r").alias("row_index"), F.col("col").alias("col_index"), F.col("h.t").alias("text_value"), F.lit(None).cast("double").alias("numeric_value"), F.lit(True).alias("is_header"))
    labels = rows.select("table_id", "row_index").distinct().select("table_id", "row_index", F.lit(0).alias("col_index"), F.concat(F.lit("행"), F.col("row_index").cast("string")).alias("text_value"), F.lit(None).cast("double").alias("numeric_value"), F.lit(False).alias("is_header"))
    every = cut(rows.unionAll(heads).unionAll(labels))
    parts = every.select("table_id").distinct().select("table_id", F.pmod("table_id", F.lit(10_000_000)).cast("string").alias("base_code"), F.when(F.col("table_id") > 10_000_000, 2).otherwise(1).alias("part"))
    return crosstable.split_part_totals(every, parts, by_metric=metrics > 1)


@query("xtb_planted_parts", PARTS + " SELECT r.table_id, r.r AS row_index, NOT bad AS passed FROM rows r JOIN n USING (table_id)")
def xtb_planted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, 1).select("table_id", (F.col("row_index") - 2).alias("row_index"), "passed")


@query("xtb_planted_metrics", PARTS + " SELECT r.table_id, r.r AS row_index, k AS metric, NOT bad AS passed FROM rows r JOIN n USING (table_id), (VALUES (1), (2)) v(k)")
def xtb_planted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics a column, each checked for itself."""
    return _parts(spark, sf_dir, 2).select("table_id", (F.col("row_index") - 2).alias("row_index"), (F.pmod(F.col("col_index") + 1, F.lit(2)) + 1).alias("metric"), "passed")
