"""How checks are shown and read: display types and groups, scopes, orders, lists of reports, tables in detail, key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import text as X
from gridloom.operators.edges import NORMAL
from gridloom.operators.relational import first_holding
from gridloom.session import cut

# Types that are shown under another one, and the spec types whose findings mark a row or a column.
SHOWN_AS = {"증감액 검수": "합계 검수", "증감률 검수": "비율 검수", "평균 검수": "비율 검수"}
METADATA = ("unit_required", "metadata_required")
ROW_SCOPE = ("row_sum", "cell_sum", "cell_relation_sum", "row_arithmetic", "row_ratio", "column_share_ratio", "row_growth_rate", "row_year_over_year_change_amount", "year_rows_change_amount", "cross_split_operand_row", "cross_table_row_sum")
COLUMN_SCOPE = ("column_sum", "region_total", "row_ratio_by_rows", "cross_table_weighted_average", "weighted_average")
# The check types in the order in which they are shown, which of them repeat, and which are of language.
TYPE_ORDER = ("합계 검수", "비율 검수", "증감률 검수", "증감액 검수", "평균 검수", "메타정보 검수", "오탈자 검수", "번역 검수", "이상치 검수", "파란색 표기 확인")
REPEATED = ("합계 검수", "비율 검수", "증감률 검수", "증감액 검수", "평균 검수")
LANGUAGE = ("오탈자 검수", "번역 검수")


def shown_type(t: Column) -> Column:
    return F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in SHOWN_AS.items()], t)


def scope(kind: Column, row: Column, col: Column, header_rows: Column) -> Column:
    """metadata, header, row, column, cell or none: what of a grid a finding of a spec type (null: no spec) marks."""
    cell = F.when(row.isNotNull() & col.isNotNull(), "cell").otherwise("none")
    without = F.when(row.isNull() | col.isNull(), "none").when(row < header_rows, "header").otherwise("cell")
    return F.when(kind.isNull(), without).when(kind.isin(*METADATA), "metadata").when(row < header_rows, "header").when(kind.isin(*ROW_SCOPE), "row").when(kind.isin(*COLUMN_SCOPE), "column").otherwise(cell)


def with_specs(checks: DataFrame, specs: DataFrame) -> DataFrame:
    """checks (rule_id) with spec_type and label of their spec; rule ids of parts (`id:part`) mean the spec before the last colon, if their own is none."""
    s = specs.select(F.col("spec_id").alias("rule_id"), F.col("type").alias("spec_type"), "label")
    own = checks.join(s, "rule_id", "left")
    part = F.regexp_replace("rule_id", ":[^:]*$", "")
    s2 = s.select(F.col("rule_id").alias("__base"), F.col("spec_type").alias("__t"), F.col("label").alias("__l"))
    return own.withColumn("__base", F.when(F.col("spec_type").isNull(), part)).join(s2, "__base", "left").withColumns({"spec_type": F.coalesce("spec_type", "__t"), "label": F.coalesce("label", "__l")}).drop("__base", "__t", "__l")


def group_key(c: str = "") -> Column:
    """Checks with one key are shown as one: repeated calculations of one formula, language checks of one cell, else one rule's."""
    col = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(""))
    at = F.concat_ws("::", *[col(k) for k in ("location", "row_index", "col_index", "current_value")])
    kind, passed = F.col("type"), F.col("status") == NORMAL
    basis = F.coalesce(F.nullif(F.trim("formula"), F.lit("")), F.nullif(F.col("rule_id"), F.lit("")))
    return (
        F.when(kind.isin(*REPEATED) & basis.isNotNull(), F.concat_ws("::", F.lit("repeated"), kind, basis, "status"))
        .when(kind == "파란색 표기 확인", F.concat_ws("::", F.lit("blue"), "status", at))
        .when(kind.isin(*LANGUAGE) & passed, F.concat_ws("::", F.lit("language"), kind))
        .when(kind.isin(*LANGUAGE), F.concat_ws("::", F.lit("language"), kind, "status", at, col("expected_value")))
        .otherwise(F.concat_ws("::", F.lit("one"), col("rule_id"), kind, col("formula"), col("detail"), "status"))
    )


def display_groups(checks: DataFrame) -> DataFrame:
    """table_id, group, type, status, checks: how many checks stand behind each shown one."""
    return checks.withColumn("group", group_key()).groupBy("table_id", "group", F.col("type"), F.col("status")).agg(F.count("*").alias("checks"))


def ranked(checks: DataFrame) -> DataFrame:
    """checks with `place`: in their table failing first, by severity, then by cell; findings without a row last."""
    severity = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    w = W.partitionBy("table_id").orderBy(F.col("passed"), severity, F.col("row_index").asc_nulls_last(), F.col("col_index").asc_nulls_last(), "type", "spec_id")
    return checks.withColumn("place", F.row_number().over(w))


def listed_reports(reports: DataFrame) -> DataFrame:
    """reports with `place`: by year, then import time, then id, latest first. A few rows."""
    return reports.withColumn("place", F.row_number().over(W.orderBy(F.desc("year"), F.desc_nulls_last("imported_at"), F.desc("id"))))


def calculation_order(highlights: DataFrame, kinds: DataFrame) -> DataFrame:
    """spec_id, table_id, row, col, layer, place: the checks of each table so that totals come before what they are made of.

    highlights: as edges.highlights gives them; kinds: spec_id, type. A check is below another of its type if its target
    is among the other's operands. Layer by layer the checks that nothing left is above of are taken out, as many rounds
    as totals are nested; checks in a circle come last. In a table the order is by type, layer, then id and cell.
    """
    rank = F.coalesce(*[F.when(F.col("type") == t, F.lit(i)) for i, t in enumerate(TYPE_ORDER)], F.lit(999))
    x = highlights.join(kinds, "spec_id").select("spec_id", "table_id", F.col("target_row").alias("row"), F.col("target_col").alias("col"), "type", rank.alias("type_order"), "cells")
    key = F.xxhash64("spec_id", "row", "col")
    nodes = cut(x.select(key.alias("node"), "spec_id", "table_id", "row", "col", "type", "type_order"))
    ops = x.select(key.alias("above"), "table_id", "type", F.explode(F.filter("cells", lambda c: c["role"] == "related")).alias("c")).select("above", "table_id", "type", F.col("c.row").alias("row"), F.col("c.col").alias("col"))
    left = cut(ops.join(nodes.select("node", "table_id", "type", "row", "col"), ["table_id", "type", "row", "col"]).where("above <> node").select("above", "node").distinct())
    open_, done, layer = nodes.select("node"), None, 0
    while not open_.isEmpty():
        free = cut(open_.join(left.select("node").distinct(), "node", "left_anti").withColumn("layer", F.lit(layer)))
        if free.isEmpty():
            free = cut(open_.withColumn("layer", F.lit(layer)))
        done = free if done is None else done.unionAll(free)
        left = cut(left.join(free.select(F.col("node").alias("above")), "above", "left_anti"))
        open_, layer = cut(open_.join(free, "node", "left_anti")), layer + 1
    if done is None:
        done = nodes.select("node", F.lit(0).alias("layer"))
    w = W.partitionBy("table_id").orderBy("type_order", "layer", "spec_id", "row", "col")
    return nodes.join(done, "node").withColumn("place", F.row_number().over(w)).select("spec_id", "table_id", "row", "col", "layer", "place")


def report_list(reports: DataFrame, tables: DataFrame, checks: DataFrame) -> DataFrame:
    """report_id, year, tables, checks, issues, suspects of every report, with one row for reports without tables or checks too."""
    t = tables.select(F.col("id").alias("table_id"), "report_id")
    n = t.groupBy("report_id").agg(F.count("*").alias("tables"))
    c = checks.join(t, "table_id").groupBy("report_id").agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("issues"), F.count_if(~F.col("passed") & (F.col("severity") == "critical")).alias("suspects"))
    out = reports.select(F.col("id").alias("report_id"), "year").join(n, "report_id", "left").join(c, "report_id", "left")
    return out.na.fill(0, ["tables", "checks", "issues", "suspects"])


def search(tables: DataFrame, words: str, status: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """Tables whose title, English title or code holds the words, whatever the case; of one status, if told so (status: table_id, status)."""
    hay = F.lower(F.concat_ws(" ", "title", "title_en", "code"))
    found = tables.where(hay.contains(words.strip().lower()))
    if status is None or only is None:
        return found
    return found.join(status.where(F.col("status") == only).select(F.col("table_id").alias("id")), "id", "left_semi")


def display_rows(cells: DataFrame) -> DataFrame:
    """table_id, row_index, label, cells (col_index -> text, or the number as shown), footnotes (col_index -> marker): one row a data row, as wide as the grid."""
    shown = F.coalesce(F.nullif(X.display(F.col("text_value")), F.lit("")), N.format_number(F.col("numeric_value")), F.lit(""))
    entry = F.struct("col_index", shown.alias("t"))
    mark = F.when(F.coalesce("footnote_marker", F.lit("")) != "", F.struct("col_index", "footnote_marker"))
    g = cells.where("not is_header").groupBy("table_id", "row_index").agg(F.max(F.when(F.col("col_index") == 0, shown)).alias("label"), F.array_sort(F.collect_list(entry)).alias("c"), F.array_sort(F.collect_list(mark)).alias("m"))
    return g.select("table_id", "row_index", "label", F.map_from_entries("c").alias("cells"), F.map_from_entries("m").alias("footnotes"))


def key_figures(cells: DataFrame, metrics: int = 3, series: int = 8) -> DataFrame:
    """table_id, metric, col_index, rank, row_index, value: of each grid's first `metrics` numeric columns the `series` largest rows, totals left aside."""
    from gridloom.functions import labels as L

    kinds = cells.where("not is_header and col_index = 0").select("table_id", "row_index", L.total_kind(F.col("text_value")).alias("kind"))
    v = cells.where("not is_header and col_index > 0").select("table_id", "row_index", "col_index", N.raw_value(F.col("numeric_value"), F.col("text_value")).alias("value")).where("value is not null")
    cols = v.select("table_id", "col_index").distinct().withColumn("metric", F.row_number().over(W.partitionBy("table_id").orderBy("col_index"))).where(F.col("metric") <= metrics)
    v = v.join(cols, ["table_id", "col_index"]).join(kinds, ["table_id", "row_index"], "left").where("kind is null")
    w = W.partitionBy("table_id", "metric").orderBy(F.desc("value"), "row_index")
    return v.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= series).select("table_id", "metric", "col_index", "rank", "row_index", "value")


def issue_places(issues: DataFrame, cells: DataFrame) -> DataFrame:
    """issues (issue_id, table_id, found) with row_index, col_index of the first cell, in reading order, whose text is the found one, else of the first that holds it; null if none does."""
    key = lambda c: F.lower(F.regexp_replace(c, X.WS, ""))
    c = cells.select("table_id", key(F.col("text_value")).alias("t"), F.struct("row_index", "col_index").alias("at")).where("t <> ''")
    i = issues.select("issue_id", "table_id", key(F.col("found")).alias("k")).where("k <> ''")
    hit = i.join(first_holding(i, c, ["table_id"]), ["table_id", "k"])
    best = hit.groupBy("issue_id").agg(F.min(F.struct("n", "at")).alias("b")).select("issue_id", "b.at.*")
    return issues.join(best, "issue_id", "left")


def decision_counts(decisions: DataFrame, by: str) -> DataFrame:
    """by, n: how often each decision was made, all of them together under 'all'."""
    return decisions.groupBy(F.col(by)).agg(F.count("*").alias("n")).unionByName(decisions.agg(F.count("*").alias("n")).select(F.lit("all").alias(by), "n"))


#: Types whose findings go into the workbooks of the main checks, in their order.
CORE = ("합계 검수", "비율 검수", "메타정보 검수", "이상치 검수")


def core_findings(checks: DataFrame, types: tuple[str, ...] = CORE) -> DataFrame:
    """The failed checks of the main types with `part` (their type's place) and `place` among the part's of their table: by row and column."""
    rank = F.coalesce(*[F.when(shown_type(F.col("type")) == t, F.lit(i + 1)) for i, t in enumerate(types)])
    c = checks.where(~F.col("passed")).withColumn("part", rank).where("part is not null")
    return c.withColumn("place", F.row_number().over(W.partitionBy("part", "table_id").orderBy(F.col("row_index").asc_nulls_last(), F.col("col_index").asc_nulls_last(), "spec_id")))


def validation_index(checks: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """base, title, table_id, row_index, col_index, row_label, column_label, current_value, expected_value, departments, officers, phones: every failed check with whom to ask."""
    from gridloom.functions import labels as L
    from gridloom.operators import grids
    from gridloom.operators.crosstable import base_code

    contact = L.contacts(F.coalesce("source", F.lit("")))
    t = tables.select(F.col("id").alias("table_id"), base_code(F.col("code")).alias("base"), "title", contact.alias("c")).select("table_id", "base", "title", *[F.array_join(f"c.{k}", " / ").alias(k) for k in ("departments", "officers", "phones")])
    heads = grids.header_stacks(cells).select("table_id", "col_index", grids.column_text(F.col("stack"), F.col("col_index")).alias("column_label"))
    rows = cells.where("not is_header and col_index = 0").select("table_id", "row_index", X.display(F.col("text_value")).alias("row_label"))
    c = checks.where(~F.col("passed")).select("table_id", "row_index", "col_index", "current_value", "expected_value")
    return c.join(t, "table_id").join(rows, ["table_id", "row_index"], "left").join(heads, ["table_id", "col_index"], "left")
