"""Queries of the review of texts, reconciliation and sinks, over the yearbook's tables with planted findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.functions.grid import deduplicated
from gridloom.operators import edges, findings, infer, language, reconcile, report
from gridloom.operators.crosstable import base_code
from gridloom.operators.relational import latest
from gridloom.plans.checks import BOTH, N, _order_checks, _specs, order_grid
from gridloom.plans.grids import CELLS, S, cells_of
from gridloom.plans.planted import GRIDS, _sums, planted
from gridloom.plans.registry import query
from gridloom.plans.scalars import D, HYPHEN
from gridloom.session import cut, table

GLOSSARY = "official_translation_glossary"


@query("language_regions", rf"""WITH n AS (SELECT regexp_replace(source, '{S}+', '', 'g') AS k, min(target) AS t FROM {GLOSSARY} WHERE category = '지역명' GROUP BY 1),
c AS (SELECT id, text_value, trim(regexp_replace(regexp_extract(text_value, '(?s)^([^A-Za-z]*?[가-힣][^A-Za-z]*?)[\s,;/]*([A-Za-z].*)?$', 1), '\s+', ' ', 'g')) AS ko, nullif(trim(regexp_extract(text_value, '(?s)^([^A-Za-z]*?[가-힣][^A-Za-z]*?)[\s,;/]*([A-Za-z].*)?$', 2)), '') AS en FROM stat_table_cells WHERE col_index = 0 AND regexp_matches(text_value, '(?s)^([^A-Za-z]*?[가-힣][^A-Za-z]*?)[\s,;/]*([A-Za-z].*)?$'))
SELECT c.id, n.t AS expected, CASE WHEN en IS NULL THEN 'suggest' WHEN regexp_replace(lower(en), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(n.t), '[^a-z0-9]+', '', 'g') THEN 'normal' ELSE 'mismatch' END AS decision FROM c JOIN n ON regexp_replace(c.ko, '{S}+', '', 'g') = n.k WHERE NOT regexp_matches(ko, '[,;]')""")
def language_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, GLOSSARY).where("category = '지역명'")
    c = table(spark, sf_dir, "stat_table_cells").where("col_index = 0").select("id", "text_value")
    return language.regions(c, "text_value", names).where(~F.col("ko").rlike("[,;]")).select("id", "expected", "decision")


@query("language_region_lists", f"WITH n AS (SELECT entry_id, source, target, row_number() OVER (ORDER BY entry_id) AS k FROM {GLOSSARY} WHERE category = '지역명' AND regexp_full_match(source, '[가-힣]+') QUALIFY count(*) OVER (PARTITION BY source) = 1) SELECT a.entry_id, a.target || ', ' || b.target AS expected FROM n a JOIN n b ON b.k = a.k + 1")
def language_region_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of a region and the next one."""
    from pyspark.sql import Window as W

    g = table(spark, sf_dir, GLOSSARY).where("category = '지역명'")
    n = g.where(F.col("source").rlike("^[가-힣]+$")).withColumn("of", F.count("*").over(W.partitionBy("source"))).where("of = 1")
    n = n.select("entry_id", F.concat_ws(" , ", "source", F.lead("source").over(W.orderBy("entry_id"))).alias("t"))  # a glossary of some hundred entries
    return language.regions(n, "t", g).where(F.col("t").contains(",")).select("entry_id", "expected")


@query("language_guardrails", """SELECT entry_id, CASE entry_id % 8 WHEN 0 THEN 'source has changed' WHEN 1 THEN 'nothing proposed' WHEN 2 THEN 'nothing differs' WHEN 3 THEN 'placeholder left' WHEN 4 THEN 'numbers differ' WHEN 5 THEN 'another script' WHEN 6 THEN 'another length' END AS refused
FROM official_translation_glossary WHERE regexp_full_match(target, '[A-Za-z -]+') AND regexp_full_match(source, '[가-힣·]+')""")
def language_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals for the English of glossary terms, seven in eight of which break one rule."""
    g = table(spark, sf_dir, GLOSSARY).where(F.col("target").rlike("^[A-Za-z -]+$") & F.col("source").rlike("^[가-힣·]+$"))
    k, t = F.col("entry_id") % 8, F.col("target")
    e = F.when(k == 1, " ").when(k == 2, F.upper(t)).when(k == 3, F.concat(t, F.lit(" <NUM>"))).when(k == 4, F.concat(t, F.lit(" 2"))).when(k == 5, F.col("source")).when(k == 6, F.concat_ws(" ", *[t] * 5, F.lit("and more and more"))).otherwise(F.concat(t, F.lit("s")))
    found = g.select("entry_id", F.when(k == 0, "x").otherwise(F.concat("source", F.lit(" "), t)).alias("source_text"), t.alias("value"), e.alias("expected"))
    return language.plausible(found).select("entry_id", "refused")


@query("language_settled", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '정상' WHEN 1 THEN '정상' WHEN 2 THEN '정상' ELSE '확인 필요' END AS status, CASE doc_id % 4 WHEN 0 THEN 'same text' WHEN 1 THEN 'same words' WHEN 2 THEN 'same date' END AS why FROM documents")
def language_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of four kinds; three call for no action."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("k"), F.concat(F.lit("2025년 "), (F.col("doc_id") % 12 + 1).cast("string"), F.lit("월 3일")).alias("day"))
    iso = F.concat(F.lit("2025-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-03"))
    c = F.when(F.col("k") == 0, F.lit("water  use\n")).when(F.col("k") == 1, F.lit("use of water")).when(F.col("k") == 2, F.col("day")).otherwise(F.lit("water use"))
    e = F.when(F.col("k") == 0, F.lit("water use")).when(F.col("k") == 1, F.lit("water, use of")).when(F.col("k") == 2, iso).otherwise(F.lit("water uses"))
    return language.settled(d.select("doc_id", c.alias("current_value"), e.alias("expected_value"), F.lit("확인 필요").alias("status"))).select("doc_id", "status", "why")


@query("language_placed", f"""WITH {CELLS}, t AS (SELECT id, code, title FROM stat_tables), k AS (SELECT table_id, row_index, col_index, lower(regexp_replace(coalesce(text_value, ''), '{S}+', '', 'g')) AS k FROM cells),
m AS (SELECT c.id AS mark_id, t.code, lower(regexp_replace(coalesce(c.text_value, ''), '{S}+', '', 'g')) AS k, c.col_index, t.id AS t FROM cells c JOIN t ON t.id = c.table_id WHERE c.id % 40 = 0 AND c.text_value IS NOT NULL),
h AS (SELECT m.mark_id, k.table_id, k.row_index, k.col_index, row_number() OVER (PARTITION BY m.mark_id ORDER BY k.k <> m.k, k.table_id, k.row_index, k.col_index) AS n FROM m JOIN stat_tables s ON s.code = m.code OR regexp_replace(s.code, '\\s+표\\s*[0-9]+$', '') = m.code JOIN k ON k.table_id = s.id AND k.col_index = m.col_index AND contains(k.k, m.k) WHERE m.k <> '')
SELECT mark_id, 'cell' AS place, table_id, row_index, col_index FROM h WHERE n = 1 UNION ALL SELECT mark_id, 'none', NULL, NULL, NULL FROM m WHERE k = ''""".replace("\\\\", "\\"))
def language_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fortieth cell's text as a mark in its table's code and column, found again."""
    t, c = table(spark, sf_dir, "stat_tables"), cut(deduplicated(table(spark, sf_dir, "stat_table_cells").select("id", "table_id", "row_index", "col_index", "text_value")))
    m = c.where("id % 40 = 0 and text_value is not null").join(t.select(F.col("id").alias("table_id"), "code"), "table_id").select(F.col("id").alias("mark_id"), "code", F.col("text_value").alias("text"), "col_index")
    return language.placed(m, t, c)


@query("language_placed_fields", "SELECT id AS mark_id, CASE WHEN id % 2 = 0 THEN 'field' ELSE 'none' END AS place FROM stat_tables WHERE length(title_en) > 8")
def language_placed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English titles as marks, which no cell holds; every second one spoilt, so that nothing holds it."""
    t = table(spark, sf_dir, "stat_tables")
    m = t.where("length(title_en) > 8").select(F.col("id").alias("mark_id"), "code", F.when(F.col("id") % 2 == 0, F.col("title_en")).otherwise(F.concat("title_en", F.lit("#?"))).alias("text"), F.lit(None).cast("int").alias("col_index"))
    return language.placed(m, t, cut(deduplicated(table(spark, sf_dir, "stat_table_cells").select("id", "table_id", "row_index", "col_index", "text_value")))).select("mark_id", "place")


@query("language_synchronised", "WITH m AS (SELECT code, title AS text, count(*) AS marks FROM stat_tables GROUP BY ALL), c AS (SELECT code, title AS text, count(*) AS checks FROM stat_tables WHERE id % 3 <> 0 GROUP BY ALL) SELECT coalesce(m.code, c.code) AS code, coalesce(m.text, c.text) AS text, coalesce(marks, 0) AS marks, coalesce(checks, 0) AS checks, CASE WHEN coalesce(checks, 0) < coalesce(marks, 0) THEN 'open' WHEN checks = marks THEN 'checked' ELSE 'stale' END AS status FROM m FULL JOIN c ON m.code = c.code AND m.text = c.text")
def language_synchronised(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "stat_tables").select("id", "code", F.col("title").alias("text"))
    return language.synchronised(t, t.where("id % 3 <> 0"))


@query("language_audit", """SELECT entry_id, CASE entry_id % 4 WHEN 0 THEN 'quarantined' WHEN 1 THEN 'verified' WHEN 2 THEN 'contradicted' ELSE 'open' END AS verdict FROM official_translation_glossary WHERE regexp_full_match(source, '[가-힣]+') AND regexp_full_match(target, '[A-Za-z-]+( [A-Za-z-]+)*') QUALIFY count(*) OVER (PARTITION BY source) = 1""")
def language_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary entries, of which one in four is misspelt, one agrees with the official list, one contradicts it and one isn't in it."""
    from pyspark.sql import Window as W

    g = table(spark, sf_dir, GLOSSARY).where(F.col("source").rlike("^[가-힣]+$") & F.col("target").rlike("^[A-Za-z-]+( [A-Za-z-]+)*$")).withColumn("of", F.count("*").over(W.partitionBy("source"))).where("of = 1")
    k = F.col("entry_id") % 4
    official = g.where("entry_id % 4 <> 3").select("source", "target")
    mine = g.select("entry_id", "source", F.when(k == 0, "Nuber").when(k == 2, F.concat("target", F.lit(" Other"))).otherwise(F.upper("target")).alias("target"))
    return language.audited(mine, official).select("entry_id", "verdict")


@query("language_rebuild", r"""SELECT id AS table_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN report_id = 8 THEN 'calculation' END, CASE WHEN starts_with(code, '2-2-') THEN 'language' END, CASE WHEN id = 2 THEN 'marks' END], lambda x: x IS NOT NULL))), ',') AS scopes FROM stat_tables WHERE report_id = 8 OR starts_with(code, '2-2-') OR id = 2""")
def language_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.createDataFrame([("report", "8", "calculation"), ("code", "2-2", "language"), ("table", "2", "marks")], "scope string, value string, what string")
    return language.rebuilt(table(spark, sf_dir, "stat_tables"), changes).select("table_id", F.array_join("scopes", ",").alias("scopes"))


@query("language_text_candidates", f"""WITH {CELLS}, f AS (SELECT id AS table_id, 'title' AS place, concat_ws(chr(10), title, nullif(title_en, '')) AS v FROM stat_tables UNION ALL SELECT id, 'section', concat_ws(chr(10), nullif(section_title, ''), nullif(section_title_en, '')) FROM stat_tables)
SELECT table_id, place, count(*) AS n FROM f WHERE regexp_matches(v, '[가-힣]|[A-Za-z]{{2,}}') GROUP BY ALL""")
def language_text_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of titles and sections to review, counted a table."""
    c = language.text_candidates(table(spark, sf_dir, "stat_tables"), cells_of(spark, sf_dir))
    return c.where("place in ('title', 'section') and kind = 'spelling'").groupBy("table_id", "place").agg(F.count("*").alias("n"))


@query("language_other_reports", "SELECT s.id, n.n - 1 AS n_other FROM stat_tables s JOIN (SELECT code, title, count(DISTINCT report_id) AS n FROM stat_tables GROUP BY ALL) n ON n.code = s.code AND n.title = s.title")
def language_other_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.other_reports(table(spark, sf_dir, "stat_tables").select("id", "report_id", "code", "title"), ["code", "title"]).select("id", "n_other")


@query("language_learn", "SELECT DISTINCT source || '새' AS source, target, 'llm_verified' AS status FROM official_translation_glossary WHERE entry_id % 2 = 0 AND source IS NOT NULL")
def language_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, GLOSSARY)
    new = g.where("entry_id % 2 = 0 and source is not null").select(F.concat("source", F.lit("새")).alias("ko"), F.col("target").alias("en"), F.lit("normal").alias("decision"))
    known = g.where("entry_id % 3 = 0").select(F.col("source").alias("ko"), F.col("target").alias("en"), F.lit("normal").alias("decision"))
    return language.learn(g, new.unionAll(known))


@query("language_preview", f"WITH {CELLS} SELECT count(*) > 0 AS texts, TRUE AS open FROM cells WHERE table_id = 2 AND regexp_matches(text_value, '[가-힣]|[A-Za-z]{{2,}}')")
def language_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = language.preview(table(spark, sf_dir, "stat_tables"), cells_of(spark, sf_dir), 2)
    return p.agg((F.count("*") > 0).alias("texts"), F.coalesce(F.bool_and(F.col("decision") == "open"), F.lit(True)).alias("open"))


@query("str_words", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9가-힣]+') AS a, regexp_extract_all(lower(source || ' ' || text), '[a-z0-9가-힣]+') AS b FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND doc_id % 2 = 0 UNION ALL SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9가-힣]+'), list_reverse(regexp_extract_all(lower(text), '[a-z0-9가-힣]+')) FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND doc_id % 2 = 1)
SELECT doc_id, list_sort(a) = list_sort(b) AS same, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) END, 6) AS overlap FROM w""")
def str_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against themselves with their source before them, or with their words in reverse order."""
    d = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    turned = F.array_join(F.reverse(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9가-힣]+"), F.lit(0))), " ")
    other = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(" ", "source", "text")).otherwise(turned)
    return d.select("doc_id", X.same_words(F.col("text"), other).alias("same"), F.round(X.token_overlap(F.col("text"), other), 6).alias("overlap"))


@query("reconcile_mismatches", r"""WITH l AS (SELECT logical_id AS key, department, officers, phones FROM logical_tables), d AS (SELECT key, CASE key % 4 WHEN 0 THEN 'department' WHEN 1 THEN 'officers' WHEN 2 THEN 'match' END AS f, department, officers FROM l)
SELECT key, f AS fields FROM d WHERE f IS NOT NULL AND (f = 'match' OR coalesce(department, '') <> '' )""")
def reconcile_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables against what is expected of them: one in four has another department, one another officer, one no entry."""
    l = table(spark, sf_dir, "logical_tables").select(F.col("logical_id").alias("key"), "department", "officers", "phones")  # noqa: E741
    k = F.col("key") % 4
    o = l.where("key % 4 <> 2 and coalesce(department, '') <> ''").select("key", F.when(k == 0, "다른부서과").otherwise(F.col("department")).alias("department"), F.when(k == 1, F.array(F.lit("없는이"))).otherwise(F.col("officers")).alias("officers"), "phones")
    return reconcile.mismatches(l, o).where("coalesce(department, '') <> '' or array_contains(fields, 'match') and key % 4 = 2").select("key", F.array_join("fields", ",").alias("fields"))


@query("reconcile_phones", "SELECT row_number AS key, phone AS phones FROM onnara_users WHERE phone <> '' AND name IS NOT NULL AND department IS NOT NULL QUALIFY count(*) OVER (PARTITION BY replace(name, ' ', '')) = 1 AND regexp_full_match(name, '[가-힣]+')")
def reconcile_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory's own people as officers, those whose name is theirs alone."""
    from pyspark.sql import Window as W

    u = table(spark, sf_dir, "onnara_users")
    own = u.where("phone <> '' and name is not null and department is not null").withColumn("of", F.count("*").over(W.partitionBy(F.replace("name", F.lit(" "), F.lit(""))))).where((F.col("of") == 1) & F.col("name").rlike("^[가-힣]+$"))
    p = reconcile.expected_phones(own.select(F.col("row_number").alias("key"), "name", "department"), u)
    return p.select("key", F.array_join("phones", ",").alias("phones"))


@query("snk_core_findings", GRIDS + "SELECT 1 AS part, table_id, r AS row_index, CAST(row_number() OVER (PARTITION BY table_id ORDER BY r) AS INT) AS place FROM rows WHERE bad")
def snk_core_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _sums(spark, sf_dir, "row_sum")
    c = c.withColumn("type", F.lit("증감액 검수")).unionAll(c.withColumn("type", F.lit("번역 검수")))
    return report.core_findings(c).select("part", "table_id", "row_index", "place")


@query("snk_validation_index", GRIDS + rf", b AS (SELECT table_id, r FROM rows WHERE bad), l AS (SELECT table_id, row_index, {D('text_value')} AS t FROM cells WHERE NOT is_header AND col_index = 0) SELECT b.table_id, b.r AS row_index, regexp_replace(s.code, '\s+표\s*[0-9]+$', '') AS base, s.title, l.t AS row_label FROM b JOIN stat_tables s ON s.id = b.table_id LEFT JOIN l ON l.table_id = b.table_id AND l.row_index = b.r")
def snk_validation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.validation_index(_sums(spark, sf_dir, "row_sum"), table(spark, sf_dir, "stat_tables"), cells_of(spark, sf_dir))
    return out.select("table_id", "row_index", "base", "title", "row_label")


@query("snk_profiles", "SELECT code, title, id AS profile, CAST(report_id AS INT) AS turn FROM stat_tables QUALIFY row_number() OVER (PARTITION BY code, title ORDER BY report_id DESC, id DESC) = 1")
def snk_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest profile of each code and title, of profiles appended report by report."""
    t = table(spark, sf_dir, "stat_tables").select("code", "title", F.col("id").alias("profile"), F.col("report_id").cast("int").alias("turn"))
    return latest(t, ["code", "title"], ["turn", "profile"])


@query("snk_copied_rows", r"""WITH r AS (SELECT max(id) AS id FROM annual_reports) SELECT c.id, t.code FROM stat_table_cells c JOIN stat_tables t ON t.id = c.table_id JOIN r ON r.id = t.report_id""")
def snk_copied_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that the copy of the last report takes along, each with its table."""
    from gridloom.sources import ingest

    last = table(spark, sf_dir, "annual_reports").agg(F.max("id").alias("id")).first()["id"]  # one row
    c = ingest.copy_report({n: table(spark, sf_dir, n) for n in ("annual_reports", "stat_tables", "stat_table_cells")}, last)
    return c["stat_table_cells"].join(c["stat_tables"].select(F.col("id").alias("table_id"), "code"), "table_id").select("id", "code")


@query("prj_inherited_dates", r"""SELECT id, coalesce(nullif(trim(base_date), ''), last_value(nullif(trim(base_date), '') IGNORE NULLS) OVER (PARTITION BY report_id, regexp_replace(code, '\s+표\s*[0-9]+$', ''), coalesce(trim(unit), '') ORDER BY table_order, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS base_date FROM stat_tables""")
def prj_inherited_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.operators import grids

    return grids.inherited_dates(table(spark, sf_dir, "stat_tables")).select("id", "base_date")


@query("infer_overlay", "SELECT t AS table_id, CASE WHEN t % 2 = 0 THEN 'column_sum' ELSE 'row_sum' END AS type, CASE WHEN t % 2 = 1 THEN 0.5 END AS confidence FROM (SELECT DISTINCT n_regionkey + 1 AS t FROM nation) UNION ALL SELECT 99, 'cell_sum', NULL")
def infer_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of rows and columns: the former go for even tables, the latter for odd ones, whose confidence is set; one spec is added."""
    t = cut(order_grid(spark, sf_dir)).groupBy("table_id").agg(F.max("row_index").alias("last"))
    rows, cols = _specs(spark, "row_sum", t, target_column=str(N + 1)), _specs(spark, "column_sum", t, target_row="last")
    suppress = t.select("table_id", F.when(F.col("table_id") % 2 == 0, "row_sum").otherwise("column_sum").alias("type"))
    confidences = t.where("table_id % 2 = 1").select(F.concat(F.lit("row_sum:"), "table_id").alias("spec_id"), F.lit(0.5).alias("confidence"))
    added = _specs(spark, "cell_sum", spark.createDataFrame([(99,)], "table_id long"))
    return infer.overlay(rows.unionAll(cols), suppress, confidences, added).select("table_id", "type", "confidence")


@query("infer_profile_status", "SELECT t AS table_id, CASE t % 3 WHEN 0 THEN 'ready' ELSE 'needs_review' END AS status, CASE t % 3 WHEN 1 THEN 1 ELSE 2 END AS specs FROM (SELECT DISTINCT n_regionkey + 1 AS t FROM nation)")
def infer_profile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with metadata alone, with a sum of high and of low confidence."""
    t = order_grid(spark, sf_dir).select("table_id").distinct()
    meta = _specs(spark, "metadata_required", t, confidence="1.0")
    sums = _specs(spark, "row_sum", t.where("table_id % 3 <> 1"), confidence="case when table_id % 3 = 0 then 0.9 else 0.6 end")
    return infer.profile_status(meta.unionAll(sums)).select("table_id", "status", "specs")


@query("flt_executable", "SELECT t AS table_id, type FROM (SELECT DISTINCT n_regionkey + 1 AS t FROM nation), (VALUES ('metadata_required'), ('row_sum')) v(type) WHERE type <> 'row_sum' OR t % 2 = 0")
def flt_executable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of metadata specs, which are one; sums of which every second isn't sure enough; an unknown type; a template below its limit; one that is switched off."""
    t = order_grid(spark, sf_dir).select("table_id").distinct()
    kinds = [("unit_required", {}), ("metadata_required", {}), ("row_sum", {"check_group": "'sum'", "confidence": "case when table_id % 2 = 0 then 0.6 else 0.59 end"}), ("unheard_of", {}), ("region_total", {"check_group": "'template'", "confidence": "0.89"}), ("column_sum", {"execute": "false"})]
    specs = _specs(spark, kinds[0][0], t)
    for kind, fields in kinds[1:]:
        specs = specs.unionAll(_specs(spark, kind, t, **fields))
    return edges.executable(specs).select("table_id", "type")


@query("grid_merged_highlights", BOTH + f"SELECT t AS table_id, r AS row, c AS col, CASE WHEN r = 6 OR c = {N + 1} THEN 'target' ELSE 'related' END AS role FROM g WHERE c <= {N + 1}")
def grid_merged_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that row and column sums mark together; what is a target of one stays a target."""
    cells = cut(order_grid(spark, sf_dir))
    last = cells.groupBy("table_id").agg(F.max("row_index").alias("last"))
    specs = _specs(spark, "row_sum", last, target_column=str(N + 1), operand_columns=f"sequence(1, {N})").unionAll(_specs(spark, "column_sum", last, target_row="last", columns=f"sequence(1, {N + 1})", operand_rows="sequence(1, last - 1)"))
    marks = edges.highlights(specs, cells, ["row_sum", "column_sum"]).withColumn("group", F.lit("sums"))
    return findings.merged_highlights(marks, "group").select("table_id", "row", "col", "role")


@query("agg_column_peers", f"WITH {CELLS} SELECT table_id, col_index, count(*) AS n, count(DISTINCT text_value) AS kinds FROM cells WHERE NOT is_header AND trim(coalesce(text_value, '')) <> '' GROUP BY ALL")
def agg_column_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts each column's cells are judged by."""
    c = cells_of(spark, sf_dir).where("not is_header and trim(coalesce(text_value, '')) <> ''")
    return c.groupBy("table_id", "col_index").agg(F.count("*").alias("n"), F.count_distinct("text_value").alias("kinds"))


@query("rules_run", "SELECT 'metadata' AS rule, id AS table_id, c AS expected_value FROM (SELECT id, unnest(list_filter([CASE WHEN trim(coalesce(unit, '')) = '' THEN 'unit' END, CASE WHEN trim(coalesce(base_date, '')) = '' THEN 'base_date' END, CASE WHEN trim(coalesce(source, '')) = '' THEN 'source' END], lambda x: x IS NOT NULL)) AS c FROM stat_tables)")
def rules_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered rules of metadata and spelling over all tables (no word of the yearbook is a known misspelling)."""
    from gridloom.operators import rules

    return rules.run(cells_of(spark, sf_dir), table(spark, sf_dir, "stat_tables"), ("metadata", "spelling")).select("rule", "table_id", "expected_value")


@query("language_refreshed", """WITH g AS (SELECT DISTINCT source, target, entry_id % 3 AS k FROM official_translation_glossary WHERE regexp_full_match(source, '[가-힣]+') AND regexp_full_match(target, '[A-Z][a-z]+( [a-z]+)*') QUALIFY count(*) OVER (PARTITION BY lower(source), lower(target)) = 1)
SELECT source, target, CASE k WHEN 0 THEN 'official_verified' WHEN 1 THEN 'approved' ELSE 'reference' END AS status, CASE k WHEN 2 THEN 5 ELSE 6 END AS n FROM g""")
def language_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary parted into three lists, all of which was also found five times in the yearbook, written in capitals."""
    from pyspark.sql import Window as W

    g = table(spark, sf_dir, GLOSSARY).where(F.col("source").rlike("^[가-힣]+$") & F.col("target").rlike("^[A-Z][a-z]+( [a-z]+)*$")).select("source", "target", (F.col("entry_id") % 3).alias("k")).distinct()
    g = g.withColumn("of", F.count("*").over(W.partitionBy("source", "target"))).where("of = 1")
    found = g.select("source", F.when(F.col("k") == 2, F.col("target")).otherwise(F.upper("target")).alias("target"), F.lit(5).alias("n"))
    return language.refreshed(g.where("k = 1"), g.where("k = 0"), found).select("source", "target", "status", "n")


@query("reconcile_audit", """SELECT logical_id AS left_id, CASE logical_id % 4 WHEN 0 THEN 'no entry' WHEN 1 THEN 'to check' WHEN 2 THEN CASE WHEN coalesce(len(officers), 0) = 0 THEN 'equal' ELSE 'differs' END ELSE 'equal' END AS decision FROM logical_tables""")
def reconcile_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables against entries of which one in four isn't there, one is matched badly, and one names other officers."""
    l = table(spark, sf_dir, "logical_tables").select(F.col("logical_id").alias("left_id"), "department", "officers", "phones")  # noqa: E741
    k = F.col("left_id") % 4
    o = l.select(F.col("left_id").alias("right_id"), "department", F.when(k == 2, F.array(F.lit("없는이"))).otherwise(F.col("officers")).alias("officers"), "phones")
    m = l.where("left_id % 4 <> 0").select("left_id", F.col("left_id").alias("right_id"), F.lit("same title").alias("method"), F.when(k == 1, 0.65).otherwise(1.0).alias("score"))
    return reconcile.audit(l, o, m).select("left_id", "decision")


@query("flt_coordinates", "SELECT t AS table_id FROM (SELECT DISTINCT n_regionkey + 1 AS t FROM nation) WHERE t % 2 = 1")
def flt_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs of which every second one names a row before the first, deep inside."""
    t = order_grid(spark, sf_dir).select("table_id").distinct()
    specs = _specs(spark, "cell_sum", t, target_row="1", operand_cells="array(named_struct('row', case when table_id % 2 = 0 then -1 else 2 end, 'column', 1, 'op', '+'))")
    return specs.where(edges.coordinates_exist()).select("table_id")
