"""Structure of grids: headers, labels, hierarchies, dense and long forms, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import labels as L
from gridloom.functions import numeric as N
from gridloom.functions import text as X


def header_counts(cells: DataFrame) -> DataFrame:
    """table_id, header_count: header rows of each grid, 1 if none is marked."""
    return cells.groupBy("table_id").agg(F.coalesce(F.max(F.when(F.col("is_header"), F.col("row_index"))) + 1, F.lit(1)).alias("header_count"))


def header_stacks(cells: DataFrame) -> DataFrame:
    """table_id, col_index, stack: display texts of the header cells of a column from top to bottom."""
    h = cells.where("is_header").groupBy("table_id", "col_index").agg(F.array_sort(F.collect_list(F.struct("row_index", X.display(F.col("text_value")).alias("t")))).alias("s"))
    return h.select("table_id", "col_index", F.transform("s", lambda x: x["t"]).alias("stack"))


def column_text(stack: Column, col_index: Column) -> Column:
    """Distinct non-empty header texts joined by ` / `; else the column's number."""
    joined = F.array_join(F.array_distinct(F.filter(stack, lambda x: x != "")), " / ")
    return F.when(joined != "", joined).otherwise(F.concat((col_index + 1).cast("string"), F.lit("열")))


def leaf(stack: Column) -> Column:
    return F.try_element_at(F.filter(stack, lambda x: x != ""), F.lit(-1))


def parent_key(stack: Column) -> Column:
    return F.array_join(F.filter(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))), lambda x: x != ""), " / ")


def filled_headers(cells: DataFrame) -> DataFrame:
    """table_id, row_index, col_index, text: header cells, a blank one with the nearest text to its left in the row."""
    w = W.partitionBy("table_id", "row_index").orderBy("col_index").rowsBetween(W.unboundedPreceding, 0)
    t = F.nullif(X.display(F.col("text_value")), F.lit(""))
    return cells.where("is_header").select("table_id", "row_index", "col_index", F.last(t, ignorenulls=True).over(w).alias("text"))


def header_paths(cells: DataFrame) -> DataFrame:
    """table_id, col_index, path, total_at: the filled header texts of a column from top to bottom, levels that repeat the one above left out; the first level that names a total (from 0)."""
    f = filled_headers(cells).where("text is not null").groupBy("table_id", "col_index").agg(F.array_sort(F.collect_list(F.struct("row_index", "text"))).alias("s"))
    texts = F.transform("s", lambda x: x["text"])
    path = F.filter(texts, lambda x, i: (i == 0) | (X.normalize(x) != X.normalize(F.get(texts, i - 1))))
    kinds = F.transform("path", lambda x: L.total_kind(x).isNotNull())
    f = f.select("table_id", "col_index", path.alias("path"))
    at = F.array_position(kinds, F.lit(True)).cast("int")
    return f.select("table_id", "col_index", "path", F.when(at > 0, at - 1).alias("total_at"))


def group_prefix(path: Column, total_at: Column) -> Column:
    """The levels above a column's total, else above its leaf."""
    return F.slice(path, 1, F.coalesce(total_at, F.greatest(F.size(path) - 1, F.lit(0))))


def starts_with(path: Column, prefix: Column) -> Column:
    """Whether a path begins with a prefix that isn't empty, by comparison keys."""
    key = lambda p: F.transform(p, lambda x: X.normalize(x))
    return (F.size(prefix) > 0) & (F.size(path) >= F.size(prefix)) & (key(F.slice(path, 1, F.greatest(F.size(prefix), F.lit(1)))) == key(prefix))


def row_parts(cells: DataFrame) -> DataFrame:
    """table_id, row_index, parts, depth, leaf: the texts of a row's label columns that aren't empty, the place of the first one (from 0), and the last one; rows without any are left out."""
    c = cells.where("not is_header").join(label_columns(cells), "table_id").withColumn("at", F.array_position("label_columns", F.col("col_index"))).where("at > 0")
    t = c.select("table_id", "row_index", (F.col("at") - 1).cast("int").alias("at"), X.display(F.col("text_value")).alias("t")).where("t <> ''")
    g = t.groupBy("table_id", "row_index").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("s"))
    return g.select("table_id", "row_index", F.transform("s", lambda x: x["t"]).alias("parts"), F.col("s")[0]["at"].alias("depth"), F.element_at("s", -1)["t"].alias("leaf"))


def header_extension(cells: DataFrame, most: int = 5) -> DataFrame:
    """table_id, header_rows: the header rows as shown, which go on for up to `most` rows below the marked ones while a row holds words of headers and no number."""
    counts = header_counts(cells)
    n = N.raw_value(F.col("numeric_value"), F.col("text_value"))
    words = X.normalize(F.col("text_value")).rlike("구분|합계|소계|연도|단위|classification|total|year|unit")
    rows = cells.join(counts, "table_id").where("row_index >= header_count").groupBy("table_id", "header_count", "row_index").agg((F.count(n) == 0).alias("bare"), F.max(F.coalesce(words, F.lit(False))).alias("words"))
    stop = rows.where(~(F.col("bare") & F.col("words"))).groupBy("table_id").agg(F.min("row_index").alias("stop"))
    out = counts.join(stop, "table_id", "left").join(cells.groupBy("table_id").agg((F.max("row_index") + 1).alias("n")), "table_id")
    return out.select("table_id", F.least(F.coalesce("stop", "n"), F.col("header_count") + most).alias("header_rows"))


def display_columns(cells: DataFrame) -> DataFrame:
    """table_id, cN, columns, ko, en: the columns as shown: label columns as one, columns without any text left out, the rest numbered in order, with their header in Korean and English."""
    labels = label_columns(cells)
    filled = cells.where(~F.col("is_header")).groupBy("table_id", "col_index").agg(F.max((X.display(F.col("text_value")) != "") | F.col("numeric_value").isNotNull()).alias("filled"))
    heads = header_paths(cells).select("table_id", "col_index", F.array_join("path", " / ").alias("head"))
    c = filled.join(labels, "table_id").join(heads, ["table_id", "col_index"], "left").withColumn("is_label", F.array_contains("label_columns", F.col("col_index"))).where("is_label or filled")
    c = c.withColumn("first", F.when(F.col("is_label"), F.element_at("label_columns", 1)).otherwise(F.col("col_index")))
    g = c.groupBy("table_id", "first").agg(F.array_sort(F.collect_list("col_index")).alias("columns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_index", F.coalesce("head", F.lit("")).alias("h")))), lambda x: x["h"]), " / ").alias("head"))
    g = g.withColumn("cN", F.row_number().over(W.partitionBy("table_id").orderBy("first")))
    return g.select("table_id", "cN", "columns", L.korean_label(F.col("head")).alias("ko"), L.english_label(F.col("head")).alias("en"))


def analysis(cells: DataFrame) -> DataFrame:
    """table_id, header_count, column_count, row_count, label_columns, columns, rows: the structure of a grid as one row: roles of its columns, counts of its rows' roles."""
    e = header_counts(cells).join(cells.groupBy("table_id").agg((F.max("col_index") + 1).alias("column_count"), F.count_distinct(F.when(~F.col("is_header"), F.col("row_index"))).alias("row_count")), "table_id")
    labels = label_columns(cells)
    heads = header_stacks(cells).select("table_id", "col_index", column_text(F.col("stack"), F.col("col_index")).alias("label"), leaf(F.col("stack")).alias("leaf_label"), parent_key(F.col("stack")).alias("parent_key")).join(labels, "table_id")
    role = F.when(F.array_contains("label_columns", F.col("col_index")), "label").otherwise(L.column_role(F.col("label")))
    cols = heads.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_index", "label", "leaf_label", "parent_key", role.alias("role")))).alias("columns"))
    rows = combined_labels(cells).groupBy("table_id", L.row_role(F.col("label")).alias("role")).agg(F.count("*").alias("n")).groupBy("table_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("rows"))
    return e.join(labels, "table_id", "left").join(cols, "table_id", "left").join(rows, "table_id", "left")


def label_columns(cells: DataFrame) -> DataFrame:
    """table_id, label_columns: the leading columns that name the rows.

    From left to right: a column without values goes on with a label; a year column counts; schedule columns after a
    label are passed over; a total's measure column ends it; a column with at most a quarter of numbers counts; more
    than three, or none, mean the first column alone.
    """
    data = cells.where("not is_header")
    v = X.display(F.col("text_value"))
    raw = N.raw_value(F.col("numeric_value"), F.col("text_value"))
    stats = data.groupBy("table_id", "col_index").agg(
        F.count_if(v != "").alias("n"), F.count(raw).alias("numbers"), F.count_if(v.rlike(r"^[’']?\d{2,4}(?:\s*\([^)]*\))?$")).alias("years"))
    heads = header_stacks(cells).select("table_id", "col_index", column_text(F.col("stack"), F.col("col_index")).alias("head"))
    s = stats.join(heads, ["table_id", "col_index"], "left")
    head = F.coalesce("head", F.lit(""))
    squeezed = F.lower(F.regexp_replace(head, X.WS, ""))
    kind = F.struct(
        F.col("col_index").alias("c"), (F.col("n") == 0).alias("empty"),
        ((F.col("col_index") == 0) & (head.contains("연도") | head.rlike(r"(?i)\byear\b")) & (F.col("years") >= 0.7 * F.col("n"))).alias("year"),
        X.is_schedule(head).alias("schedule"), ((F.col("numbers") > 0) & (head.rlike("전체|합계|총계") | squeezed.contains("total") | squeezed.rlike(r"^계(\([^)]*\))?$"))).alias("total"),
        (F.col("numbers") <= 0.25 * F.greatest("n", F.lit(1))).alias("words"),
    )
    cols = s.groupBy("table_id").agg(F.array_sort(F.collect_list(kind)).alias("cols"))
    start = F.struct(F.array().cast("array<int>").alias("labels"), F.lit(False).alias("over"))

    def step(acc: Column, x: Column) -> Column:
        add = F.struct(F.concat(acc["labels"], F.array(x["c"])).alias("labels"), F.lit(False).alias("over"))
        stop = F.struct(acc["labels"].alias("labels"), F.lit(True).alias("over"))
        any_ = F.size(acc["labels"]) > 0
        return F.when(acc["over"], acc).when(x["empty"], F.when(any_, add).otherwise(stop)).when(x["year"], add).when(any_ & x["schedule"], acc).when(any_ & x["total"], stop).when(x["words"], add).otherwise(stop)

    labels = F.aggregate("cols", start, step)["labels"]
    return cols.select("table_id", labels.alias("l")).select("table_id", F.when((F.size("l") > 3) | (F.size("l") == 0), F.array(F.lit(0))).otherwise(F.col("l")).alias("label_columns"))


def combined_labels(cells: DataFrame) -> DataFrame:
    """table_id, row_index, label: distinct texts of the label columns, joined by blanks."""
    c = cells.where("not is_header").join(label_columns(cells), "table_id").where(F.array_contains("label_columns", F.col("col_index")))
    t = c.groupBy("table_id", "row_index").agg(F.array_sort(F.collect_list(F.struct("col_index", X.display(F.col("text_value")).alias("t")))).alias("s"))
    return t.select("table_id", "row_index", F.array_join(F.array_distinct(F.filter(F.transform("s", lambda x: x["t"]), lambda x: x != "")), " ").alias("label"))


def dense(cells: DataFrame) -> DataFrame:
    """table_id, row_index, texts: one array per row, null where a cell is missing. Rows are bounded by the grid's width."""
    r = cells.groupBy("table_id", "row_index").agg(F.map_from_entries(F.collect_list(F.struct("col_index", "text_value"))).alias("m"), F.max("col_index").alias("last"))
    return r.select("table_id", "row_index", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.col("m")[i]).alias("texts"))


def long(rows: DataFrame) -> DataFrame:
    """The inverse of dense: table_id, row_index, col_index, text_value of the cells that are there."""
    return rows.select("table_id", "row_index", F.posexplode("texts").alias("col_index", "text_value")).where("text_value is not null")


def structure_signatures(cells: DataFrame) -> DataFrame:
    """table_id, signature: hash of extents, header texts and row labels; values don't change it."""
    e = cells.groupBy("table_id").agg((F.max("row_index") + 1).alias("rows"), (F.max("col_index") + 1).alias("cols"))
    h = header_stacks(cells).groupBy("table_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("col_index", "stack")))).alias("head"))
    l = combined_labels(cells).groupBy("table_id").agg(F.sum(F.xxhash64("row_index", X.normalize(F.col("label"))).cast("decimal(20,0)")).alias("labels"))  # noqa: E741
    j = e.join(h, "table_id", "left").join(l, "table_id", "left")
    return j.select("table_id", F.substring(X.fingerprint(F.col("rows"), F.col("cols"), F.col("head"), F.col("labels")), 1, 20).alias("signature"))


def hierarchy(tables: DataFrame) -> DataFrame:
    """domain, section, tables: the tables of each section in order, as array of (table_order, code, title, title_en)."""
    t = tables.select("domain", "section_title", F.struct("table_order", "code", "title", "title_en").alias("t"))
    return t.groupBy("domain", "section_title").agg(F.array_sort(F.collect_list("t")).alias("tables"))


def templates(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """table_id, regional, yearly, sex_grade, balance: kinds of grids by their labels, headers and titles (tables: id, title, code)."""
    l = cells.where("not is_header and col_index = 0").select("table_id", X.display(F.col("text_value")).alias("t"))  # noqa: E741
    short = [k for k in X.REGIONS if len(k) == 2]
    by_rows = l.groupBy("table_id").agg(F.count_distinct(F.when(F.substring("t", 1, 2).isin(*short), F.substring("t", 1, 2))).alias("regions"), F.count_if(X.normalize(F.col("t")).rlike(r"^\d{4}$")).alias("years"))
    heads = header_stacks(cells).groupBy("table_id").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("stack"))), " ").alias("h"))
    x = by_rows.join(heads, "table_id", "left").join(tables.select(F.col("id").alias("table_id"), F.concat_ws(" ", "title", "code").alias("title")), "table_id", "left")
    h, all_ = X.normalize(F.col("h")), X.normalize(F.concat_ws(" ", "h", "title"))
    return x.select(
        "table_id", (h.contains("지역") | (F.col("regions") >= 8)).alias("regional"), (h.rlike("연도|year") | (F.col("years") >= 4)).alias("yearly"),
        (h.rlike("남성|여성|male|female") & all_.rlike("직급|계급|grade")).alias("sex_grade"), h.rlike("연말잔액|수입액|지출액|잔액율|잔액률|balance|income|expenditure").alias("balance"),
    )


def inherited_units(tables: DataFrame) -> DataFrame:
    """A part without a unit takes its siblings' unit if the parts before it have exactly one; the base date likewise from the part before."""
    w = W.partitionBy("report_id", F.regexp_replace("code", r"(?U)\s+표\s*\d+$", "")).orderBy("table_order", "id").rowsBetween(W.unboundedPreceding, -1)
    unit = F.nullif(F.trim("unit"), F.lit(""))
    seen = F.collect_set(unit).over(w)
    date = F.last(F.nullif(F.trim("base_date"), F.lit("")), ignorenulls=True).over(w)
    return tables.withColumns({"unit": F.coalesce(unit, F.when(F.size(seen) == 1, seen[0]), F.lit("")), "base_date": F.coalesce(F.nullif(F.trim("base_date"), F.lit("")), date, F.lit(""))})


def inherited_dates(tables: DataFrame) -> DataFrame:
    """A part without a base date takes that of the part before it with the same unit."""
    w = W.partitionBy("report_id", F.regexp_replace("code", r"(?U)\s+표\s*\d+$", ""), F.coalesce(F.trim("unit"), F.lit(""))).orderBy("table_order", "id").rowsBetween(W.unboundedPreceding, -1)
    own = F.nullif(F.trim("base_date"), F.lit(""))
    return tables.withColumn("base_date", F.coalesce(own, F.last(own, ignorenulls=True).over(w), F.lit("")))
