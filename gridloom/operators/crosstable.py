"""Checks between tables: near-duplicates of neighbours, totals over the parts of a split table, codes and hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import text as X
from gridloom.operators.edges import row_labels


def base_code(code: Column) -> Column:
    """A part's code without its part number."""
    return F.regexp_replace(code, r"(?U)\s+표\s*\d+$", "")


def part_number(code: Column) -> Column:
    return F.nullif(F.regexp_extract(code, r"(?U)\s+표\s*(\d+)$", 1), F.lit("")).cast("int")


def parent_code(code: Column) -> Column:
    """The code one level up; null for a top code."""
    base = base_code(code)
    return F.when(base.contains("-"), F.regexp_replace(base, r"-[^-]*$", ""))


def adjacent_similarity(cells: DataFrame, tables: DataFrame, least: float = 0.0) -> DataFrame:
    """table_id, previous_id, similarity: share of equal cells with the table before it under the same parent (tables: table_id, parent, table_order).

    A cell that only one of both has differs.
    """
    pairs = tables.withColumn("previous_id", F.lag("table_id").over(W.partitionBy("parent").orderBy("table_order", "table_id"))).where("previous_id is not null").select("table_id", "previous_id")
    text = F.lower(F.regexp_replace(F.coalesce("text_value", F.lit("")), r"(?U)[\s·,._\-()/%]+", ""))
    c = cells.select("table_id", "row_index", "col_index", text.alias("x"))
    own = pairs.join(c, "table_id")
    before = pairs.join(c.withColumnsRenamed({"table_id": "previous_id", "x": "y"}), "previous_id")
    both = own.join(before, ["table_id", "previous_id", "row_index", "col_index"], "full")
    return both.groupBy("table_id", "previous_id").agg(F.avg(F.when(F.col("x") == F.col("y"), 1.0).otherwise(0.0)).alias("similarity")).where(F.col("similarity") >= least)


#: Share of equal cells from which neighbours are near-duplicates.
ALIKE = 0.92


def adjacent_duplicates(cells: DataFrame, tables: DataFrame, least: float = ALIKE) -> DataFrame:
    """table_id, previous_id, similarity of near-duplicate neighbours with different titles and base codes (tables: table_id, parent, table_order, title, code)."""
    t = tables.select("table_id", X.normalize(F.col("title")).alias("title"), base_code(F.col("code")).alias("base"))
    near = adjacent_similarity(cells, tables.select("table_id", "parent", "table_order"), least)
    near = near.join(t, "table_id").join(t.withColumnsRenamed({"table_id": "previous_id", "title": "title2", "base": "base2"}), "previous_id")
    return near.where("title <> title2 and base <> base2").select("table_id", "previous_id", "similarity")


def with_anomaly_notes(tables: DataFrame, duplicates: DataFrame, code: str = "code") -> DataFrame:
    """tables (id, note, ..) whose near-duplicates have the previous table's code added to their note; a note that names it already stays."""
    d = duplicates.join(tables.select(F.col("id").alias("previous_id"), F.col(code).alias("__code")), "previous_id").select(F.col("table_id").alias("id"), "__code")
    line = F.concat(F.lit("[확인 필요] "), "__code", F.lit(" 표와 같은 값"))
    note = F.coalesce("note", F.lit(""))
    new = F.when(F.col("__code").isNull() | note.contains(line), F.col("note")).when(note == "", line).otherwise(F.concat(note, F.lit("\n"), line))
    return tables.join(d, "id", "left").withColumn("note", new).drop("__code")


def rebuilt_spec(rule_id: Column) -> Column:
    """What a rule id like `cross.split_part_row_total:role=target:target=5:rows=2,3` says, as map of its parts with `type`; null if it is none."""
    known = r"^cross\.[a-z_]+(:[a-z_]+=[^:=]*)*$"
    rest = F.regexp_replace(rule_id, "^[^:]*:?", "")
    parts = F.when(rest == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(rest, F.lit(":"), F.lit("=")))
    return F.when(rule_id.rlike(known), F.map_concat(F.create_map(F.lit("type"), F.regexp_extract(rule_id, r"^cross\.([a-z_]+)", 1)), parts))


def split_part_totals(cells: DataFrame, parts: DataFrame, least_checks: int = 5, least_passed: float = 0.6, by_metric: bool = False) -> DataFrame:
    """Totals in part 1 against the details of all parts (parts: table_id, base_code, part), rows joined by label.

    A total column's first header text is 계, 합계.., total..; details are the other columns. Rows that a part lacks are
    skipped. A table's checks count only if there are enough of them and enough passed. Told so, a total is checked
    against the details of its own metric alone: the last header text of columns with more than one.
    """
    first = F.lower(F.regexp_replace(F.coalesce("text_value", F.lit("")), r"(?U)\s+", ""))
    texts = F.when(first != "", F.col("row_index"))
    heads = cells.where("is_header and col_index > 0").groupBy("table_id", "col_index").agg(F.min_by(first, texts).alias("head"), F.when(F.lit(by_metric) & (F.count(texts) > 1), F.max_by(first, texts)).otherwise("").alias("metric"))
    heads = heads.withColumn("is_total", F.coalesce(F.col("head").startswith("합계") | (F.col("head") == "계") | F.col("head").contains("total"), F.lit(False)))
    labels = row_labels(cells).join(parts, "table_id")
    n = parts.groupBy("base_code").agg(F.count("*").alias("n_parts"))
    everywhere = labels.groupBy("base_code", "label").agg(F.count_distinct("table_id").alias("k")).join(n, "base_code").where("k = n_parts and n_parts > 1").select("base_code", "label")
    rows = labels.groupBy("base_code", "part", "table_id", "label").agg(F.max("row_index").alias("row_index")).join(everywhere, ["base_code", "label"])
    value = N.cross_value(F.col("numeric_value"), F.col("text_value"), True)
    v = cells.where("not is_header and col_index > 0").select("table_id", "row_index", "col_index", value.alias("v")).join(heads.select("table_id", "col_index", "is_total", "metric"), ["table_id", "col_index"]).join(rows, ["table_id", "row_index"])
    details = v.where("not is_total").groupBy("base_code", "label", "metric").agg(F.sum("v").alias("expected_value"), F.count("*").alias("n"), F.count("v").alias("n_v")).where("n >= 2 and n = n_v")
    totals = v.where("is_total and part = 1 and v is not null").select("base_code", "label", "metric", "table_id", "row_index", "col_index", F.col("v").alias("current_value"))
    out = totals.join(details, ["base_code", "label", "metric"]).withColumn("passed", F.abs(F.col("current_value") - F.col("expected_value")) <= 1.0)
    w = W.partitionBy("base_code")
    out = out.withColumns({"checks": F.count("*").over(w), "good": F.avg(F.col("passed").cast("double")).over(w)})
    return out.where((F.col("checks") >= least_checks) & (F.col("good") >= least_passed)).drop("checks", "good", "n", "n_v")
