"""Queries of text review, reconciliation and the rules without specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import text as X
from gridloom.operators import language, reconcile, rules
from gridloom.plans.grids import CELLS, COMPACT, NORMAL, NUM, S, cells_of, parse_sql
from gridloom.plans.registry import query
from gridloom.session import cut, table

RANK = "CASE status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(language.STATUS_ORDER)) + f" ELSE {len(language.STATUS_ORDER)} END"
KEY = lambda c: NORMAL.replace("{c}", c)
NAMES = f"names AS (SELECT DISTINCT entry_id, target, status, {KEY('name')} AS key FROM (SELECT entry_id, target, status, unnest(list_concat([source], coalesce(aliases, []))) AS name FROM official_translation_glossary) WHERE {KEY('name')} <> '')"


@query("glossary_exact", f"WITH {NAMES} SELECT t.id, n.entry_id FROM stat_tables t JOIN names n ON {KEY('t.section_title')} = n.key QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY {RANK}, n.entry_id DESC) <= 8")
def glossary_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "stat_tables").select("id", "section_title")
    return language.exact_lookup(t, "section_title", table(spark, sf_dir, "official_translation_glossary")).select("id", "entry_id")


@query("glossary_contains", f"WITH {NAMES}, t AS (SELECT id, {KEY('title')} AS k FROM stat_tables), h AS (SELECT t.id, n.entry_id, n.status, max(length(n.key)) AS size FROM t JOIN names n ON length(n.key) >= 2 AND contains(t.k, n.key) GROUP BY ALL) SELECT id, entry_id FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY {RANK}, size DESC, entry_id DESC) <= 16")
def glossary_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.contained_lookup(table(spark, sf_dir, "stat_tables"), "title", table(spark, sf_dir, "official_translation_glossary"), "id").select("id", "entry_id")


_LINES = r"regexp_split_to_array(trim({c}), '\s*\n\s*')"
_INLINE = r"^([가-힣][가-힣0-9·()+A-Z ]*?)\s+([A-Za-z][A-Za-z0-9 ,.''&()/-]+)$"


def pair_sql(c: str) -> tuple[str, str]:
    """(Korean, English) of a bilingual text, null if it is none."""
    lines = _LINES.replace("{c}", c)
    two = f"(len({lines}) = 2 AND regexp_matches({lines}[1], '[가-힣]') AND NOT regexp_matches({lines}[1], '[a-z]{{2,}}') AND regexp_matches({lines}[2], '[A-Za-z]{{2,}}') AND NOT regexp_matches({lines}[2], '[가-힣]'))"
    one = f"(len({lines}) = 1 AND regexp_matches(trim({c}), '{_INLINE}') AND NOT regexp_matches(regexp_extract(trim({c}), '{_INLINE}', 1), '[a-z]'))"
    return f"CASE WHEN {two} THEN {lines}[1] WHEN {one} THEN trim(regexp_extract(trim({c}), '{_INLINE}', 1)) END", f"CASE WHEN {two} THEN {lines}[2] WHEN {one} THEN regexp_extract(trim({c}), '{_INLINE}', 2) END"


KO, EN = pair_sql("text_value")
PAIRS = f"pairs AS (SELECT ko, en, count(*) AS n FROM (SELECT {KO} AS ko, {EN} AS en FROM stat_table_cells) WHERE ko IS NOT NULL GROUP BY ALL)"


@query("language_harvest", f"WITH {PAIRS} SELECT ko, en, n FROM pairs")
def language_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.harvest(table(spark, sf_dir, "stat_table_cells"), "text_value")


TRUST = ", ".join(f"'{s}'" for s in language.TRUSTED)


@query("language_decide", f"WITH {PAIRS}, {NAMES}, t AS (SELECT DISTINCT key, {KEY('target')} AS en FROM names WHERE status IN ({TRUST})) SELECT CASE WHEN t.key IS NOT NULL THEN 'normal' ELSE 'open' END AS decision, count(*) AS n FROM pairs p LEFT JOIN t ON t.key = {KEY('p.ko')} AND t.en = {KEY('p.en')} GROUP BY 1")
def language_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = language.harvest(table(spark, sf_dir, "stat_table_cells"), "text_value")
    return language.decide(pairs, table(spark, sf_dir, "official_translation_glossary")).groupBy("decision").agg(F.count("*").alias("n"))


@query("language_candidates", f"""WITH {CELLS}, c AS (SELECT table_id, row_index, col_index, trim(text_value) AS text_value FROM cells WHERE regexp_matches(text_value, '[가-힣]|[A-Za-z]{{2,}}')),
k AS (SELECT table_id, row_index, col_index, 'spelling' AS kind FROM c UNION ALL SELECT table_id, row_index, col_index, 'translation' FROM c WHERE {KO} IS NOT NULL) SELECT table_id, kind, count(*) AS n FROM k GROUP BY ALL""")
def language_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.candidates(cells_of(spark, sf_dir)).groupBy("table_id", "kind").agg(F.count("*").alias("n"))


def _anomaly_sql(n: str = NUM) -> str:
    t = COMPACT.replace("{c}", "text_value")
    u = "lower(regexp_replace(coalesce(unit, ''), '[ (),]', '', 'g'))"
    return rf"""CASE WHEN {t} IN ('', '-', '－', '―', '–', '—', '_', '＿') OR regexp_full_match({t}, '[''’]?[0-9]{{1,4}}[./~-][0-9]{{1,2}}([./~-][0-9]{{1,2}})?[.]?') OR regexp_full_match({t}, '[''’][0-9]{{2}}') OR regexp_full_match({t}, '{n}\({n}%?\)%?') OR NOT regexp_matches({t}, '^[-+()0-9 ,.%''’`´ㅡㆍ·]+$') OR NOT regexp_matches({t}, '[0-9]') THEN NULL
    WHEN regexp_matches({t}, '[0-9][ㅡㆍ''’`´·][0-9]') THEN 'wrong separator' WHEN regexp_matches({t}, '[0-9][,.]{{2,}}[0-9]') THEN 'doubled separator' WHEN regexp_full_match({t}, '{n}%?\)') THEN CASE WHEN numbers >= 2 THEN 'unmatched bracket' END
    WHEN contains({t}, ',') AND NOT regexp_full_match({t}, '\(?{n}%?\)?') THEN 'wrong grouping' WHEN regexp_full_match({t}, '[+-]?[0-9]{{1,3}}([.][0-9]{{3}})+') AND NOT contains(coalesce(unit, ''), '%') AND (regexp_matches({u}, '{N.COUNTED}') OR grouped >= 1 OR whole >= 3) THEN 'point for comma'
    WHEN {parse_sql('text_value')} IS NULL THEN 'not a number' END"""


_PCT = "regexp_replace(" + COMPACT.replace("{c}", "text_value") + ", '%$', '')"
SPOILT = "CASE id % 5 WHEN 0 THEN replace(text_value, ',', '.') WHEN 1 THEN text_value || ')' WHEN 2 THEN replace(text_value, ',', 'ㅡ') WHEN 3 THEN replace(text_value, ',', ',,') ELSE text_value END"


@query("language_format", rf"""WITH {CELLS}, s AS (SELECT table_id, row_index, col_index, CASE WHEN row_index % 7 = 0 THEN {SPOILT} ELSE text_value END AS text_value FROM cells WHERE NOT is_header AND text_value IS NOT NULL),
    p AS (SELECT *, count({parse_sql('text_value')}) OVER w AS numbers, count(*) FILTER (WHERE regexp_full_match({_PCT}, '[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+')) OVER w AS grouped, count(*) FILTER (WHERE regexp_full_match({_PCT}, '[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+') OR regexp_full_match({_PCT}, '[+-]?[0-9]+')) OVER w AS whole FROM s WINDOW w AS (PARTITION BY table_id, col_index)),
    r AS (SELECT p.table_id, row_index, col_index, coalesce({_anomaly_sql()}, CASE WHEN regexp_matches(text_value, '[가-힣]|[A-Za-z]{{2,}}') THEN CASE WHEN regexp_matches(text_value, '[\x{{fffd}}\x{{00}}-\x{{08}}\x{{0b}}\x{{0c}}\x{{0e}}-\x{{1f}}]') THEN 'broken character' WHEN regexp_matches(text_value, '[0-9][ㅡㆍ''’`´][0-9]') THEN 'wrong mark between digits' WHEN regexp_matches(text_value, '[가-힣A-Za-z0-9][,.;:]{{2,}}[가-힣A-Za-z0-9]') THEN 'doubled mark' END END) AS reason FROM p LEFT JOIN stat_tables t ON t.id = p.table_id)
    SELECT * FROM r WHERE reason IS NOT NULL""")
def language_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearbook's cells, a part of every seventh row spoilt in one of four ways."""
    k, t = F.col("id") % 5, F.col("text_value")
    bad = F.when(k == 0, F.replace(t, F.lit(","), F.lit("."))).when(k == 1, F.concat(t, F.lit(")"))).when(k == 2, F.replace(t, F.lit(","), F.lit("ㅡ"))).when(k == 3, F.replace(t, F.lit(","), F.lit(",,"))).otherwise(t)
    c = cells_of(spark, sf_dir).withColumn("text_value", F.when(F.col("row_index") % 7 == 0, bad).otherwise(t))
    return language.format_candidates(c, table(spark, sf_dir, "stat_tables"))


SPELL = "|".join(language.SPELLING)


@query("language_spelling_planted", f"WITH {CELLS}, p AS (SELECT table_id, row_index, col_index, CASE id % 9 WHEN 0 THEN text_value || ' 진행율' WHEN 1 THEN 'Nuber ' || text_value ELSE text_value END AS t FROM cells WHERE is_header), f AS (SELECT table_id, row_index, col_index, '진행율' AS found, '진행률' AS expected FROM p WHERE contains(t, '진행율') UNION ALL SELECT table_id, row_index, col_index, 'Nuber', 'Number' FROM p WHERE contains(t, 'Nuber')) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY row_index, col_index, found) <= 2")
def language_spelling_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with two known misspellings planted, the first two of a table."""
    c = cells_of(spark, sf_dir).where("is_header")
    t = F.when(F.col("id") % 9 == 0, F.concat("text_value", F.lit(" 진행율"))).when(F.col("id") % 9 == 1, F.concat(F.lit("Nuber "), "text_value")).otherwise(F.col("text_value"))
    return language.spelling(c.withColumn("text_value", t), most=2)


@query("str_bilingual_forms", f"SELECT id, {KO} AS ko, {EN} AS en FROM stat_table_cells WHERE ({KO}) IS NOT NULL")
def str_bilingual_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bilingual pair of any cell, in two lines or in one."""
    return table(spark, sf_dir, "stat_table_cells").select("id", X.bilingual_pair(F.col("text_value")).alias("p")).where("p is not null").select("id", "p.*")


@query("language_spelling", f"SELECT table_id, count(*) AS n FROM (SELECT table_id FROM stat_table_cells WHERE regexp_matches(text_value, '{SPELL}')) GROUP BY table_id")
def language_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.spelling(cells_of(spark, sf_dir)).groupBy("table_id").agg(F.count("*").alias("n"))


MASK = "sha256(regexp_replace(text, '[0-9][0-9,.]*', '<NUM>', 'g'))"


@query("language_cache_hit", f"WITH f AS (SELECT doc_id, lang, {MASK} AS h FROM documents WHERE text IS NOT NULL) SELECT a.doc_id, EXISTS (SELECT 1 FROM f b WHERE b.lang = 'ko' AND b.h = a.h) AS cached FROM f a WHERE a.lang IS NULL OR a.lang <> 'ko'")
def language_cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", X.fingerprint(X.masked(F.col("text"))).alias("fingerprint"))
    cache = f.where("lang = 'ko'").groupBy("fingerprint").agg(F.lit("normal").alias("decision"))
    hit, miss = language.from_cache(f.where("lang is null or lang <> 'ko'"), cache)
    return hit.select("doc_id", F.lit(True).alias("cached")).unionAll(miss.select("doc_id", F.lit(False).alias("cached")))


@query("reconcile_titles")
def reconcile_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of each report with the owners' titles of its year."""
    return reconcile.match_titles(*_titles(spark, sf_dir))


@query("reconcile_over_years")
def reconcile_over_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, and then with those of the year before."""
    return reconcile.match_over_years(*_titles(spark, sf_dir))


@query("reconcile_similar_titles", f"WITH r AS (SELECT DISTINCT {KEY('title')} AS k FROM stat_tables) SELECT a.k || 'x' AS key, a.k AS rkey FROM r a WHERE a.k <> ''")
def reconcile_similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title with a letter more, paired with its own; other pairs aren't shown."""
    k = table(spark, sf_dir, "stat_tables").select(F.lit(1).alias("block"), X.normalize(F.col("title")).alias("key")).where("key <> ''").distinct()
    found = reconcile.similar_titles(k.withColumn("key", F.concat("key", F.lit("x"))), k, 0.8)
    return found.where(F.col("key") == F.concat("rkey", F.lit("x"))).select("key", "rkey")


def _titles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    years = table(spark, sf_dir, "annual_reports").select(F.col("id").alias("report_id"), F.col("year").alias("block"))
    l = table(spark, sf_dir, "logical_tables").join(years, "report_id").select(F.col("logical_id").alias("left_id"), "block", "title", F.col("table_order").alias("n"))  # noqa: E741
    r = table(spark, sf_dir, "reference_owners").select(F.col("owner_id").alias("right_id"), F.col("year").alias("block"), F.regexp_replace("title", r"\s+-\s.*$", "").alias("title"), F.col("row_number").alias("n"))

    def placed(x: DataFrame, i: str) -> DataFrame:
        return x.join(x.groupBy("block").agg(F.max("n").alias("m")), "block").select(i, "block", "title", (F.col("n") / F.col("m")).alias("pos"))

    return placed(l, "left_id"), placed(r, "right_id")


@query("reconcile_users", "WITH u AS (SELECT replace(name, ' ', '') AS key, row_number AS user_row, department FROM onnara_users), n AS (SELECT row_number AS id, replace(name, ' ', '') AS key FROM onnara_users WHERE name IS NOT NULL) SELECT n.id, count(*) AS namesakes FROM n JOIN u USING (key) GROUP BY n.id")
def reconcile_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "onnara_users").where("name is not null").select(F.col("row_number").alias("id"), F.replace("name", F.lit(" "), F.lit("")).alias("key"))
    return u.join(u.groupBy("key").agg(F.count("*").alias("namesakes")), "key").select("id", "namesakes")


def _dep(c: str) -> str:
    last = rf"trim(list_extract(regexp_split_to_array({c}, '\s*(?:->|→|⇒)\s*'), -1))"
    return rf"regexp_replace(regexp_replace({last}, '{S}+', '', 'g'), '담당관실$', '담당관')"


def _same_dep(a: str, b: str) -> str:
    x, y = _dep(a), _dep(b)
    return f"coalesce({x} = {y} OR ends_with({x}, {y}) AND length({y}) >= 3 OR ends_with({y}, {x}) AND length({x}) >= 3, FALSE)"


@query("reconcile_resolved", f"""WITH n AS (SELECT DISTINCT logical_id AS id, unnest(officers) AS name, department FROM logical_tables), u AS (SELECT regexp_replace(name, '{S}+', '', 'g') AS key, row_number AS user_row, department AS d, display_department AS dd, coalesce(phone = '', TRUE) AS no_phone FROM onnara_users),
j AS (SELECT n.*, u.*, {_same_dep('n.department', 'u.d')} OR {_same_dep('n.department', 'u.dd')} AS own FROM n LEFT JOIN u ON u.key = regexp_replace(n.name, '{S}+', '', 'g'))
SELECT id, name, department, CASE WHEN bool_or(own AND user_row IS NOT NULL) THEN arg_min(user_row, CASE WHEN own THEN CAST(no_phone AS INT) * 10000000 + user_row END) WHEN count(user_row) = 1 THEN min(user_row) END AS user_row,
CASE WHEN bool_or(own AND user_row IS NOT NULL) THEN 'name and department' WHEN count(user_row) = 1 THEN 'name alone' WHEN count(user_row) > 1 THEN 'several' ELSE 'none' END AS how FROM j GROUP BY id, name, department""")
def reconcile_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "logical_tables").select(F.col("logical_id").alias("id"), F.explode("officers").alias("name"), "department")
    return reconcile.resolve_users(names, table(spark, sf_dir, "onnara_users"))


_SET = lambda c: f"list_sort(list_distinct(list_transform(coalesce({c}, []), lambda v: regexp_replace(v, '{S}+', '', 'g'))))"
_DIGITS = lambda c: f"list_transform(coalesce({c}, []), lambda v: regexp_replace(v, '[^0-9]', '', 'g'))"


@query("reconcile_sets", f"""WITH l AS (SELECT logical_id, officers, phones, lag(officers) OVER w AS before, lag(phones) OVER w AS phones_before FROM logical_tables WINDOW w AS (PARTITION BY code ORDER BY report_id, logical_id))
SELECT logical_id, CASE WHEN coalesce(len(before), 0) = 0 THEN 'missing here' WHEN coalesce(len(officers), 0) = 0 THEN 'missing there' WHEN {_SET('before')} = {_SET('officers')} THEN 'equal' ELSE 'different' END AS officers, len(list_filter({_DIGITS('phones_before')}, lambda v: NOT list_contains({_DIGITS('phones')}, v))) = 0 AS phones_kept FROM l""")
def reconcile_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Officers and phones of a table against those of the same code in the report before."""
    l = table(spark, sf_dir, "logical_tables").select("logical_id", "code", "report_id", "officers", "phones")  # noqa: E741
    from pyspark.sql import Window as W

    w = W.partitionBy("code").orderBy("report_id", "logical_id")
    x = l.withColumns({"before": F.lag("officers").over(w), "phones_before": F.lag("phones").over(w)})
    return x.select("logical_id", reconcile.compare_sets(F.col("before"), F.col("officers")).alias("officers"), reconcile.covered(F.col("phones_before"), F.col("phones")).alias("phones_kept"))


@query("rules_structure")
def rules_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.from_structure(cut(cells_of(spark, sf_dir)))


@query("rules_subtotals")
def rules_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.subtotals(cells_of(spark, sf_dir))


SUB = """WITH d AS (SELECT n_regionkey AS g, n_nationkey AS k, count(c_custkey) AS v FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL), s AS (SELECT g, sum(v) + CASE WHEN g % 2 = 0 THEN 5 ELSE 0 END AS v, sum(v) AS e FROM d GROUP BY g)"""


@query("rules_planted_subtotals", SUB + " SELECT 1 AS table_id, CAST(g * 6 + 1 AS INT) AS row_index, 2 AS col_index, CAST(v AS DOUBLE) AS current_value, CAST(e AS DOUBLE) AS expected_value FROM s WHERE v <> e")
def rules_planted_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid of customers a nation, each region's nations under its subtotal, which is off by 5 in every second region."""
    d = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("v")), "n_nationkey", "left").na.fill(0, ["v"])
    r = F.expr("row_number() over (partition by n_regionkey order by n_nationkey)")
    rows = d.select("n_regionkey", (F.col("n_regionkey") * 6 + 1 + r).cast("int").alias("row_index"), F.col("n_name").alias("l"), "v")
    rows = rows.unionAll(d.groupBy("n_regionkey").agg((F.col("n_regionkey") * 6 + 1).cast("int").alias("row_index"), F.lit("소계 Sub-total").alias("l"), (F.sum("v") + F.when(F.col("n_regionkey") % 2 == 0, 5).otherwise(0)).alias("v")))
    cells = rows.select(F.lit(1).cast("long").alias("table_id"), "row_index", F.posexplode(F.array(F.concat(F.lit("지역"), F.col("n_regionkey").cast("string")), "l", F.col("v").cast("string"))).alias("col_index", "text_value"), F.lit(None).cast("double").alias("numeric_value"), F.lit(False).alias("is_header"))
    return rules.subtotals(cells).withColumn("table_id", F.col("table_id").cast("int"))


@query("rules_planted_change", """WITH g AS (SELECT n_regionkey + 1 AS t, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, 100 + n_nationkey AS a, 50 + n_nationkey * 2 AS b FROM nation)
SELECT t AS table_id, CAST(r AS INT) AS row_index, 3 AS col_index, a - b + 5.0 AS current_value, CAST(a - b AS DOUBLE) AS expected_value FROM g WHERE r = 2 UNION ALL SELECT t, CAST(r AS INT), 4, round(100.0 * (a - b) / b, 2) + 3, 100.0 * (a - b) / b FROM g WHERE r = 3 AND abs(round(100.0 * (a - b) / b, 2) + 3 - 100.0 * (a - b) / b) <= abs(round(100.0 * (a - b) / b, 2) + 3 - 100.0 * (a - b) / a) UNION ALL SELECT t, CAST(r AS INT), 4, round(100.0 * (a - b) / b, 2) + 3, 100.0 * (a - b) / a FROM g WHERE r = 3 AND abs(round(100.0 * (a - b) / b, 2) + 3 - 100.0 * (a - b) / b) > abs(round(100.0 * (a - b) / b, 2) + 3 - 100.0 * (a - b) / a)""")
def rules_planted_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values, their difference (wrong in the second row) and its rate (wrong in the third) a nation, one grid a region."""
    n = table(spark, sf_dir, "nation").withColumn("row_index", F.expr("cast(row_number() over (partition by n_regionkey order by n_nationkey) as int)"))
    a, b = 100 + F.col("n_nationkey"), 50 + F.col("n_nationkey") * 2
    rate = F.round(100.0 * (a - b) / b, 2)
    texts = [F.col("n_name"), a, b, a - b + F.when(F.col("row_index") == 2, 5).otherwise(0), rate + F.when(F.col("row_index") == 3, 3).otherwise(0)]
    body = n.select((F.col("n_regionkey") + 1).cast("long").alias("table_id"), "row_index", F.posexplode(F.array(*[x.cast("string") for x in texts])).alias("col_index", "text_value"), F.lit(False).alias("is_header"))
    head = n.select((F.col("n_regionkey") + 1).cast("long").alias("table_id")).distinct().select("table_id", F.lit(0).alias("row_index"), F.posexplode(F.array(*[F.lit(x) for x in ("구분", "올해 (a)", "지난해 (b)", "증감 (a-b)", "증감비율 (a-b)/b(%)")])).alias("col_index", "text_value"), F.lit(True).alias("is_header"))
    out = rules.change_columns(cut(body.unionAll(head).withColumn("numeric_value", F.lit(None).cast("double"))))
    return out.withColumn("table_id", F.col("table_id").cast("int"))


@query("rules_change")
def rules_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.change_columns(cut(cells_of(spark, sf_dir)))
