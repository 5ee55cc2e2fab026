"""Queries of grid structure, scalar functions and metadata over the yearbook tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import text as X
from gridloom.functions.grid import deduplicated
from gridloom.operators import crosstable, findings, grids
from gridloom.plans.registry import query
from gridloom.session import table

#: White space as Java's (?U)\s, and the cleaning functions, for the SQL side.
S = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DISPLAY = "trim(regexp_replace(coalesce({c}, ''), '" + S + "+', ' ', 'g'))"
NORMAL = "lower(regexp_replace(coalesce({c}, ''), '(" + S + r"|[·,._\-()/%])+', '', 'g'))"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "−"
NARROW = ("".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "-").replace("'", "''")
COMPACT = "regexp_replace(translate({c}, '" + WIDE + "', '" + NARROW + "'), '" + S + "+', '', 'g')"
NUM = r"[+-]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]+)?"


def parse_sql(c: str) -> str:
    t = COMPACT.replace("{c}", c)
    t = rf"regexp_replace({t}, '^({NUM})\({NUM}%\).*$', '\1')"
    t = rf"regexp_replace({t}, '^\(({NUM})\)$', '\1')"
    return f"CASE WHEN regexp_full_match({t}, '{NUM}%?') THEN CAST(regexp_replace({t}, '[,%]', '', 'g') AS DOUBLE) END"


#: One cell per place: the smallest id stands.
CELLS = "cells AS (SELECT * FROM stat_table_cells QUALIFY row_number() OVER (PARTITION BY table_id, row_index, col_index ORDER BY id) = 1)"


def cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "stat_table_cells").drop("footnote_marker"))


@query("num_parse", f"SELECT id, {parse_sql('text_value')} AS value FROM stat_table_cells WHERE NOT is_header")
def num_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stat_table_cells").where("not is_header").select("id", N.parse_number(F.col("text_value")).alias("value"))


@query("num_policies", f"""
WITH v AS (SELECT id, text_value IS NOT NULL AND {DISPLAY.replace("{c}", "text_value")} = '' OR text_value IS NULL AS blank, {DISPLAY.replace("{c}", "text_value")} AS d, coalesce(numeric_value, {parse_sql("text_value")}) AS raw FROM stat_table_cells WHERE NOT is_header AND col_index > 0)
SELECT count(*) AS n, count(raw) AS raw, count(coalesce(raw, CASE WHEN d IN ('-', '－', '―', '_', '＿') THEN 0 END)) AS target,
count(coalesce(raw, CASE WHEN d IN ('-', '－', '―', '_', '＿', '') THEN 0 END)) AS operand, count(coalesce(raw, CASE WHEN d IN ('-', '－', '―') THEN 0 END)) AS cross_null FROM v""")
def num_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, t = table(spark, sf_dir, "stat_table_cells").where("not is_header and col_index > 0"), F.col("numeric_value"), F.col("text_value")
    return c.agg(F.count("*").alias("n"), F.count(N.raw_value(n, t)).alias("raw"), F.count(N.target_value(n, t)).alias("target"), F.count(N.operand_value(n, t)).alias("operand"), F.count(N.cross_value(n, t, False)).alias("cross_null"))


@query("num_format", "SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN format('{:,}', CAST(l_extendedprice AS BIGINT)) ELSE NULL END AS shown FROM lineitem")
def num_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(p == F.floor(p), N.format_number(p)).alias("shown"))


@query("num_format_all", "SELECT l_orderkey, l_linenumber, CASE WHEN x = floor(x) THEN format('{:,}', CAST(x AS BIGINT)) ELSE format('{:,.1f}', x) END AS shown FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN floor(l_extendedprice) ELSE l_extendedprice END AS x FROM lineitem)")
def num_format_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("l_linenumber") % 2 == 0, F.floor("l_extendedprice").cast("double")).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.format_number(p).alias("shown"))


@query("str_normalize", f"SELECT id, {NORMAL.replace("{c}", 'title')} AS title_key, {NORMAL.replace("{c}", 'title_en')} AS title_en_key, {DISPLAY.replace("{c}", 'source')} AS source_text FROM stat_tables")
def str_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stat_tables").select("id", X.normalize(F.col("title")).alias("title_key"), X.normalize(F.col("title_en")).alias("title_en_key"), X.display(F.col("source")).alias("source_text"))


@query("str_codes", r"SELECT id, regexp_replace(code, '\s+표\s*[0-9]+$', '') AS base, TRY_CAST(nullif(regexp_extract(code, '\s+표\s*([0-9]+)$', 1), '') AS INT) AS part, regexp_replace(regexp_replace(code, '\s+표\s*[0-9]+$', ''), '-[^-]*$', '') AS parent FROM stat_tables")
def str_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("code")
    return table(spark, sf_dir, "stat_tables").select("id", crosstable.base_code(c).alias("base"), crosstable.part_number(c).alias("part"), crosstable.parent_code(c).alias("parent"))


@query("str_scripts", "SELECT doc_id, regexp_matches(text, '[가-힣]') AS hangul, regexp_matches(text, '[A-Za-z]{2,}') AS latin FROM documents")
def str_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.has_hangul(F.col("text")).alias("hangul"), X.has_latin(F.col("text")).alias("latin"))


@query("str_fingerprint", "SELECT doc_id, sha256(regexp_replace(text, '[0-9][0-9,.]*', '<NUM>', 'g')) AS h FROM documents WHERE text IS NOT NULL")
def str_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.fingerprint(X.masked(F.col("text"))).alias("h"))


@query("str_bilingual", r"SELECT id, split_part(trim(text_value), chr(10), 1) AS ko, split_part(trim(text_value), chr(10), 2) AS en FROM stat_table_cells WHERE is_header AND regexp_full_match(trim(text_value), '[가-힣]+\n[A-Z][A-Za-z]+')")
def str_bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "stat_table_cells").where(F.col("is_header") & F.trim("text_value").rlike(r"^[가-힣]+\n[A-Z][A-Za-z]+$"))
    return c.select("id", X.bilingual_pair(F.col("text_value")).alias("p")).select("id", "p.*")


@query("str_chunks")
def str_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("pos", "chunk"))


@query("prj_header_counts", "SELECT table_id, coalesce(max(CASE WHEN is_header THEN row_index END) + 1, 1) AS header_count FROM stat_table_cells GROUP BY table_id")
def prj_header_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.header_counts(table(spark, sf_dir, "stat_table_cells"))


@query("prj_column_text", f"""WITH {CELLS}, h AS (SELECT table_id, col_index, row_index, {DISPLAY.replace("{c}", "text_value")} AS t FROM cells WHERE is_header),
f AS (SELECT table_id, col_index, t, min(row_index) AS r FROM h WHERE t <> '' GROUP BY ALL)
SELECT c.table_id, c.col_index, coalesce(string_agg(f.t, ' / ' ORDER BY f.r), (c.col_index + 1) || '열') AS head FROM (SELECT DISTINCT table_id, col_index FROM h) c LEFT JOIN f USING (table_id, col_index) GROUP BY c.table_id, c.col_index""")
def prj_column_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = grids.header_stacks(cells_of(spark, sf_dir))
    return s.select("table_id", "col_index", grids.column_text(F.col("stack"), F.col("col_index")).alias("head"))


@query("prj_leaf_parent", f"""WITH {CELLS}, h AS (SELECT table_id, col_index, row_index, {DISPLAY.replace("{c}", "text_value")} AS t, max(row_index) OVER (PARTITION BY table_id, col_index) AS m FROM cells WHERE is_header)
SELECT table_id, col_index, arg_max(t, row_index) FILTER (WHERE t <> '') AS leaf, coalesce(string_agg(t, ' / ' ORDER BY row_index) FILTER (WHERE t <> '' AND row_index < m), '') AS parent FROM h GROUP BY ALL""")
def prj_leaf_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = grids.header_stacks(cells_of(spark, sf_dir))
    return s.select("table_id", "col_index", grids.leaf(F.col("stack")).alias("leaf"), grids.parent_key(F.col("stack")).alias("parent"))


@query("prj_filled_headers", f"""WITH {CELLS} SELECT table_id, row_index, col_index, last_value(nullif({DISPLAY.replace("{c}", "text_value")}, '') IGNORE NULLS) OVER (PARTITION BY table_id, row_index ORDER BY col_index) AS text FROM cells WHERE is_header""")
def prj_filled_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.filled_headers(cells_of(spark, sf_dir))


@query("prj_label_columns")
def prj_label_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.label_columns(cells_of(spark, sf_dir))


@query("prj_combined_labels")
def prj_combined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.combined_labels(cells_of(spark, sf_dir))


@query("prj_row_labels", f"WITH {CELLS} SELECT table_id, row_index, {NORMAL.replace("{c}", 'text_value')} AS label FROM cells WHERE col_index = 0 AND NOT is_header AND {NORMAL.replace("{c}", 'text_value')} <> ''")
def prj_row_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.operators.edges import row_labels

    return row_labels(cells_of(spark, sf_dir))


@query("prj_dense", f"WITH {CELLS} SELECT table_id, row_index, count(*) AS cells, max(col_index) + 1 AS width FROM cells GROUP BY ALL")
def prj_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.dense(cells_of(spark, sf_dir).withColumn("text_value", F.coalesce("text_value", F.lit("")))).select("table_id", "row_index", F.size(F.filter("texts", lambda x: x.isNotNull())).cast("long").alias("cells"), F.size("texts").alias("width"))


@query("prj_dense_rows", f"WITH {CELLS} SELECT table_id, row_index, string_agg(coalesce(text_value, '∅'), '|' ORDER BY col_index) AS line FROM cells GROUP BY ALL")
def prj_dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each row in order; grids of the yearbook have no holes."""
    d = grids.dense(cells_of(spark, sf_dir))
    return d.select("table_id", "row_index", F.array_join(F.transform("texts", lambda x: F.coalesce(x, F.lit("∅"))), "|").alias("line"))


@query("prj_hierarchy_full", "SELECT domain, section_title, string_agg(table_order || ':' || code || ':' || title || ':' || coalesce(title_en, ''), '|' ORDER BY table_order, code, title, title_en) AS tables FROM stat_tables GROUP BY ALL")
def prj_hierarchy_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = grids.hierarchy(table(spark, sf_dir, "stat_tables"))
    return h.select("domain", "section_title", F.array_join(F.transform("tables", lambda t: F.concat_ws(":", t["table_order"].cast("string"), t["code"], t["title"], F.coalesce(t["title_en"], F.lit("")))), "|").alias("tables"))


@query("prj_round_trip", f"WITH {CELLS} SELECT table_id, row_index, col_index, text_value FROM cells WHERE text_value IS NOT NULL")
def prj_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.long(grids.dense(cells_of(spark, sf_dir)))


query("prj_hierarchy", "SELECT domain, section_title, count(*) AS tables, arg_min(code, {'o': table_order, 'c': code, 't': title}) AS first_code FROM stat_tables GROUP BY ALL")(
    lambda spark, sf_dir: grids.hierarchy(table(spark, sf_dir, "stat_tables")).select("domain", "section_title", F.size("tables").cast("long").alias("tables"), F.col("tables")[0]["code"].alias("first_code"))
)


@query("prj_signatures")
def prj_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.structure_signatures(cells_of(spark, sf_dir))


@query("prj_templates", f"""WITH {CELLS}, l AS (SELECT table_id, {DISPLAY.replace("{c}", "text_value")} AS t, {NORMAL.replace("{c}", "text_value")} AS k FROM cells WHERE NOT is_header AND col_index = 0),
r AS (SELECT table_id, count(DISTINCT CASE WHEN substr(t, 1, 2) IN ({", ".join(f"'{k}'" for k in X.REGIONS if len(k) == 2)}) THEN substr(t, 1, 2) END) AS regions, count(*) FILTER (WHERE regexp_full_match(k, '[0-9]{{4}}')) AS years FROM l GROUP BY 1),
h AS (SELECT table_id, string_agg({NORMAL.replace("{c}", "text_value")}, '|') AS h FROM cells WHERE is_header GROUP BY 1), x AS (SELECT r.*, coalesce(h, '') AS h, {NORMAL.replace("{c}", "concat_ws(' ', title, code)")} AS t FROM r LEFT JOIN h USING (table_id) LEFT JOIN stat_tables s ON s.id = r.table_id)
SELECT table_id, contains(h, '지역') OR regions >= 8 AS regional, regexp_matches(h, '연도|year') OR years >= 4 AS yearly, regexp_matches(h, '남성|여성|male|female') AND regexp_matches(h || t, '직급|계급|grade') AS sex_grade, regexp_matches(h, '연말잔액|수입액|지출액|잔액율|잔액률|balance|income|expenditure') AS balance FROM x""")
def prj_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.templates(cells_of(spark, sf_dir), table(spark, sf_dir, "stat_tables"))


FILLED = f"""f AS (SELECT table_id, row_index, col_index, last_value(nullif({DISPLAY.replace("{c}", "text_value")}, '') IGNORE NULLS) OVER (PARTITION BY table_id, row_index ORDER BY col_index) AS t FROM cells WHERE is_header),
g AS (SELECT *, {NORMAL.replace("{c}", "t")} AS k, lag({NORMAL.replace("{c}", "t")}) OVER (PARTITION BY table_id, col_index ORDER BY row_index) AS before FROM f WHERE t IS NOT NULL)"""


@query("prj_header_paths", f"WITH {CELLS}, {FILLED} SELECT table_id, col_index, string_agg(t, ' > ' ORDER BY row_index) AS path, count(*) AS depth FROM g WHERE before IS NULL OR before <> k GROUP BY ALL")
def prj_header_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = grids.header_paths(cells_of(spark, sf_dir))
    return p.select("table_id", "col_index", F.array_join("path", " > ").alias("path"), F.size("path").cast("long").alias("depth"))


@query("prj_group_prefixes", f"WITH {CELLS}, {FILLED}, p AS (SELECT table_id, col_index, list(k ORDER BY row_index) AS p FROM g WHERE before IS NULL OR before <> k GROUP BY ALL) SELECT a.table_id, a.col_index, b.col_index AS other FROM p a JOIN p b ON a.table_id = b.table_id AND a.col_index <> b.col_index AND len(a.p) > 1 AND len(b.p) >= len(a.p) - 1 AND b.p[1:len(a.p) - 1] = a.p[1:len(a.p) - 1] WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.table_id = a.table_id AND g.col_index = a.col_index AND regexp_matches(g.k, '^(계|합계|총계|소계)|total'))")
def prj_group_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a grid that begin with the group of another one (which names no total)."""
    p = grids.header_paths(cells_of(spark, sf_dir))
    total = F.exists("path", lambda x: X.normalize(x).rlike("^(계|합계|총계|소계)|total"))
    a = p.where(~total).select("table_id", "col_index", grids.group_prefix(F.col("path"), F.col("total_at")).alias("prefix"))
    j = a.join(p.select("table_id", F.col("col_index").alias("other"), "path"), "table_id").where("col_index <> other")
    return j.where(grids.starts_with(F.col("path"), F.col("prefix"))).select("table_id", "col_index", "other")


@query("prj_row_parts")
def prj_row_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.row_parts(cells_of(spark, sf_dir))


@query("prj_header_extension", f"""WITH {CELLS}, n AS (SELECT table_id, coalesce(max(CASE WHEN is_header THEN row_index END) + 1, 1) AS h, max(row_index) + 1 AS n FROM cells GROUP BY 1),
r AS (SELECT c.table_id, c.row_index, count(coalesce(numeric_value, {parse_sql("text_value")})) = 0 AND coalesce(bool_or(regexp_matches({NORMAL.replace("{c}", "text_value")}, '구분|합계|소계|연도|단위|classification|total|year|unit')), FALSE) AS more FROM cells c JOIN n USING (table_id) WHERE c.row_index >= n.h GROUP BY ALL)
SELECT n.table_id, least(coalesce(min(CASE WHEN NOT more THEN row_index END), n.n), n.h + 5) AS header_rows FROM n LEFT JOIN r USING (table_id) GROUP BY n.table_id, n.n, n.h""")
def prj_header_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.header_extension(cells_of(spark, sf_dir))


@query("prj_display_columns")
def prj_display_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.display_columns(cells_of(spark, sf_dir))


@query("prj_analysis", f"WITH {CELLS} SELECT table_id, coalesce(max(CASE WHEN is_header THEN row_index END) + 1, 1) AS header_count, max(col_index) + 1 AS column_count, count(DISTINCT CASE WHEN NOT is_header THEN row_index END) AS row_count, count(DISTINCT CASE WHEN is_header THEN col_index END) AS heads FROM cells GROUP BY 1")
def prj_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.analysis(cells_of(spark, sf_dir)).select("table_id", "header_count", "column_count", "row_count", F.size("columns").cast("long").alias("heads"))


@query("prj_inherited_units", r"""WITH p AS (SELECT id, unit, base_date, coalesce(nullif(trim(unit), ''), CASE WHEN len(list_distinct(list(nullif(trim(unit), '')) OVER w)) = 1 THEN list_distinct(list(nullif(trim(unit), '')) OVER w)[1] END, '') AS u,
coalesce(nullif(trim(base_date), ''), last_value(nullif(trim(base_date), '') IGNORE NULLS) OVER w, '') AS d FROM stat_tables
WINDOW w AS (PARTITION BY report_id, regexp_replace(code, '\s+표\s*[0-9]+$', '') ORDER BY table_order, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT id, u AS unit, d AS base_date FROM p""")
def prj_inherited_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.inherited_units(table(spark, sf_dir, "stat_tables")).select("id", "unit", "base_date")


@query("chk_metadata_required", "SELECT id AS table_id, trim(coalesce(unit, '')) = '' AS no_unit, trim(coalesce(base_date, '')) = '' AS no_base_date, trim(coalesce(source, '')) = '' AS no_source FROM stat_tables WHERE trim(coalesce(unit, '')) = '' OR trim(coalesce(base_date, '')) = '' OR trim(coalesce(source, '')) = ''")
def chk_metadata_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = {f"no_{c}": F.trim(F.coalesce(c, F.lit(""))) == "" for c in ("unit", "base_date", "source")}
    return table(spark, sf_dir, "stat_tables").withColumns(no).where("no_unit or no_base_date or no_source").select(F.col("id").alias("table_id"), *no)


@query("chk_outliers", f"""WITH {CELLS}, v AS (SELECT table_id, row_index, col_index, coalesce(numeric_value, {parse_sql("text_value")}) AS x FROM cells WHERE NOT is_header AND col_index > 0),
m AS (SELECT table_id, col_index, median(x) AS med FROM v WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) >= 5),
d AS (SELECT v.*, abs(x - med) AS dev FROM v JOIN m USING (table_id, col_index) WHERE x IS NOT NULL), a AS (SELECT table_id, col_index, median(dev) AS mad FROM d GROUP BY ALL HAVING median(dev) <> 0)
SELECT table_id, row_index, col_index, round(dev / mad, 4) AS score FROM d JOIN a USING (table_id, col_index) WHERE dev / mad > 20 QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY dev / mad DESC, row_index DESC, col_index DESC) <= 5""")
def chk_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells_of(spark, sf_dir).where("not is_header and col_index > 0")
    v = c.select("table_id", "row_index", "col_index", N.raw_value(F.col("numeric_value"), F.col("text_value")).alias("x"))
    return findings.outliers(v, ["table_id", "col_index"], "x", ["row_index", "col_index"], 20.0, 5, 5, ["table_id"]).select("table_id", "row_index", "col_index", F.round("score", 4).alias("score"))


@query("chk_growth_scan", f"WITH {CELLS} SELECT DISTINCT table_id FROM cells WHERE regexp_matches({NORMAL.replace("{c}", 'text_value')}, '증감률|증가율|growthrate')")
def chk_growth_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(spark, sf_dir).where(X.normalize(F.col("text_value")).rlike("증감률|증가율|growthrate")).select("table_id").distinct()


@query("latest_snapshot", "SELECT year, id AS report_id FROM annual_reports WHERE NOT is_archived QUALIFY row_number() OVER (PARTITION BY year ORDER BY imported_at DESC, id DESC) = 1")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.operators.snapshots import snapshot_reports

    return snapshot_reports(table(spark, sf_dir, "annual_reports"))


@query("logical_groups", r"SELECT report_id, regexp_replace(code, '\s+표\s*[0-9]+$', '') AS base, count(*) AS parts, list(id ORDER BY table_order, id) AS part_ids FROM stat_tables GROUP BY ALL")
def logical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "stat_tables").select("report_id", crosstable.base_code(F.col("code")).alias("base"), F.struct("table_order", "id").alias("p"))
    g = t.groupBy("report_id", "base").agg(F.count("*").alias("parts"), F.array_sort(F.collect_list("p")).alias("p"))
    return g.select("report_id", "base", "parts", F.transform("p", lambda x: x["id"]).alias("part_ids"))


@query("adjacent_tables", r"SELECT id, lag(id) OVER (PARTITION BY report_id, regexp_replace(regexp_replace(code, '\s+표\s*[0-9]+$', ''), '-[^-]*$', '') ORDER BY table_order, id) AS previous_id FROM stat_tables")
def adjacent_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("report_id", crosstable.parent_code(F.col("code"))).orderBy("table_order", "id")
    return table(spark, sf_dir, "stat_tables").select("id", F.lag("id").over(w).alias("previous_id"))


@query("neighbour_rows", f"WITH {CELLS}, l AS (SELECT table_id, row_index, text_value FROM cells WHERE col_index = 0) SELECT a.table_id, a.row_index, b.text_value AS before, c.text_value AS after FROM l a LEFT JOIN l b ON b.table_id = a.table_id AND b.row_index = a.row_index - 1 LEFT JOIN l c ON c.table_id = a.table_id AND c.row_index = a.row_index + 1")
def neighbour_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("table_id").orderBy("row_index")
    near = lambda k: F.max("text_value").over(w.rangeBetween(k, k))
    return cells_of(spark, sf_dir).where("col_index = 0").select("table_id", "row_index", near(-1).alias("before"), near(1).alias("after"))
