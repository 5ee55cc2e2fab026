"""Queries of the scalar functions over labels, notes and metadata texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import labels as L
from gridloom.functions import text as X
from gridloom.plans.grids import CELLS, DISPLAY, NORMAL, S, cells_of
from gridloom.plans.registry import query
from gridloom.session import table

D = lambda c: DISPLAY.replace("{c}", c)
K = lambda c: NORMAL.replace("{c}", c)
HYPHEN = lambda c: r"regexp_replace(regexp_replace({c}, '([A-Za-z])-[ \t]*\r?\n[ \t]*([a-z])', '\1\2', 'g'), '([A-Za-z])-[ \t]*\r?\n[ \t]*([a-z])', '\1\2', 'g')".replace("{c}", c)
ENDS = lambda c, e: f"regexp_matches({c}, '({'|'.join(e)})$')"
HAS = lambda c, e: f"regexp_matches({c}, '{'|'.join(e)}')"


@query("str_review_text", f"SELECT doc_id, {D(HYPHEN('replace(nfc_normalize(text), chr(160), chr(32))'))} AS review FROM documents")
def str_review_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.review_text(F.col("text")).alias("review"))


@query("str_hyphens", f"SELECT doc_id, {HYPHEN(chr(39).join(['replace(text, ', ' ', ', chr(10))']).replace('chr(10)', 'chr(45) || chr(10)'))} AS joined FROM documents WHERE lang = 'en'")
def str_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English texts with every blank made a broken word, put together again."""
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    return d.select("doc_id", X.join_hyphenated(F.replace("text", F.lit(" "), F.lit("-\n"))).alias("joined"))


@query(
    "str_term_keys",
    r"""SELECT entry_id, lower(regexp_replace(source, '(""" + S + r"""|[·･,._\-–—()\[\]{}''"/])+', '', 'g')) AS source_key,
    trim(regexp_replace(lower(regexp_replace(target, '([A-Za-z])(?:\s+-\s*|-\s+)([A-Za-z])', '\1\2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS target_key,
    coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(source, '\([^)]*[A-Za-z][A-Za-z0-9+*/= -]*\)', '', 'g'), '""" + S + r"""+', ' ', 'g'), '^[ :;|/]+|[ :;|/]+$', '', 'g'), ''),
    regexp_replace(regexp_replace(source, '""" + S + r"""+', ' ', 'g'), '^[ :;|/]+|[ :;|/]+$', '', 'g')) AS lookup FROM official_translation_glossary""",
)
def str_term_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "official_translation_glossary")
    return g.select("entry_id", L.source_key(F.col("source")).alias("source_key"), L.target_key(F.col("target")).alias("target_key"), L.lookup_text(F.col("source")).alias("lookup"))


def _levels(kind: str, levels, other: str) -> str:
    return f"WHEN k = '{kind}' THEN CASE " + " ".join(f"WHEN {ENDS('s', e)} THEN '{v}'" for v, e in levels) + f" ELSE '{other}' END"


@query(
    "str_categories",
    f"""WITH g AS (SELECT entry_id, regexp_replace(source, '{S}+', '', 'g') AS s, lower(target) AS t FROM official_translation_glossary),
    c AS (SELECT *, CASE WHEN NOT {ENDS('s', L.NOT_PLACES)} AND {ENDS('s', L.PLACE_ENDINGS)} AND {HAS('t', L.PLACE_WORDS)} THEN '행정구역명' WHEN {ENDS('s', L.BODY_ENDINGS)} OR {HAS('t', L.BODY_WORDS)} THEN '기관명' WHEN {ENDS('s', L.EVENT_ENDINGS)} THEN '행사·사업명' ELSE '일반 용어' END AS k FROM g)
    SELECT entry_id, k AS category, CASE {_levels('행정구역명', L.PLACE_LEVELS, '행정구역 일반')} {_levels('기관명', L.BODY_LEVELS, '기관 일반')} {_levels('행사·사업명', L.EVENT_LEVELS, '행사·사업 일반')} ELSE '일반' END AS subcategory FROM c""",
)
def str_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "official_translation_glossary").select("entry_id", "source", L.category(F.col("source"), F.col("target")).alias("category"))
    return g.select("entry_id", "category", L.subcategory(F.col("source"), F.col("category")).alias("subcategory"))


OPEN, CLOSE = "chr(57344)", "chr(57345)"
EN = L.ENGLISH.replace("'", "''")


def _balanced_sql(c: str) -> str:
    for _ in range(4):
        c = rf"regexp_replace({c}, '\(([^()]*)\)', {OPEN} || '\1' || {CLOSE}, 'g')"
    return rf"trim(translate(regexp_replace({c}, '(^|[^0-9])\)', '\1', 'g'), {OPEN} || {CLOSE}, '()'))"


_REST = f"regexp_replace({D(rf'''regexp_replace(d, '{EN}', '\1', 'g')''')}, '^[ /]+|[ /]+$', '', 'g')"


@query(
    "str_labels",
    f"""WITH h AS (SELECT id, {D(HYPHEN('text_value'))} AS d FROM stat_table_cells WHERE is_header OR col_index = 0), r AS (SELECT id, d, {_REST} AS r0 FROM h),
    k AS (SELECT id, d, CASE WHEN contains(r0, '구분') AND contains(r0, '지역') AND contains(lower(d), 'region') THEN '지역' ELSE r0 END AS r FROM r),
    b AS (SELECT id, d, {_balanced_sql(r"regexp_replace(r, '^구분([^ ])', '구분 / \1')")} AS x FROM k)
    SELECT id, CASE WHEN x <> '' THEN x ELSE d END AS ko, nullif(list_aggregate(list_transform(regexp_extract_all(d, '{EN}', 2), lambda x: trim(x)), 'string_agg', ' '), '') AS en FROM b""",
)
def str_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "stat_table_cells").where("is_header or col_index = 0")
    return c.select("id", L.korean_label(F.col("text_value")).alias("ko"), L.english_label(F.col("text_value")).alias("en"))


@query(
    "str_balanced",
    f"SELECT id, {_balanced_sql('substr(source, 15)')} AS plain FROM stat_tables WHERE contains(source, '(')",
)
def str_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources cut within a bracket, so that some brackets only close."""
    t = table(spark, sf_dir, "stat_tables").where(F.col("source").contains("("))
    return t.select("id", L.balanced(F.expr("substr(source, 15)")).alias("plain"))


@query(
    "str_footnotes",
    r"""WITH m AS (SELECT id AS table_id, list_transform(list_distinct(regexp_extract_all(coalesce(note, '') || ' 주1) 주 2)', '주\s*(\d+)\)', 1)), lambda x: x || ')') AS ms FROM stat_tables),
    c AS (SELECT c.id, regexp_replace(CASE WHEN c.id % 2 = 0 THEN text_value || '1)' ELSE text_value END, '\s+$', '') AS b, ms FROM stat_table_cells c JOIN m USING (table_id) WHERE NOT is_header),
    f AS (SELECT id, b, list_filter(ms, lambda m: ends_with(b, m) AND length(b) > length(m)) AS fits, length(b) - length(replace(b, '(', '')) AS o, length(b) - length(replace(b, ')', '')) AS cl FROM c),
    g AS (SELECT id, b, CASE WHEN len(fits) > 0 AND NOT (o > 0 AND o = cl) THEN list_extract(list_sort(list_transform(fits, lambda m: lpad(CAST(99 - length(m) AS VARCHAR), 2, '0') || m)), 1) END AS p FROM f),
    h AS (SELECT id, b, substr(p, 3) AS marker FROM g)
    SELECT id, regexp_replace(CASE WHEN marker IS NOT NULL THEN rtrim(substr(b, 1, length(b) - length(marker))) WHEN regexp_full_match(b, '\d{4}\s*\d+\)') THEN regexp_extract(b, '^(\d{4})', 1) ELSE trim(b) END, '^([+-]?)0,0*(\d+(?:\.\d+)?)$', '\1\2') AS text,
    coalesce(marker, CASE WHEN regexp_full_match(b, '\d{4}\s*\d+\)') THEN regexp_extract(b, '^\d{4}\s*(\d+\))$', 1) END, '') AS marker FROM h""",
)
def str_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose every second text gets a marker, parted again by the markers that their table's note (and a planted one) defines."""
    m = table(spark, sf_dir, "stat_tables").select(F.col("id").alias("table_id"), L.footnote_markers(F.concat(F.coalesce("note", F.lit("")), F.lit(" 주1) 주 2)"))).alias("markers"))
    c = table(spark, sf_dir, "stat_table_cells").where("not is_header").join(m, "table_id")
    text = F.when(F.col("id") % 2 == 0, F.concat("text_value", F.lit("1)"))).otherwise(F.col("text_value"))
    return c.select("id", L.footnote_split(text, F.col("markers")).alias("f")).select("id", "f.text", "f.marker")


@query("str_captions", rf"SELECT id, {D(HYPHEN(r'''regexp_extract('▫ ' || title || chr(10) || '현황 (단위: ' || coalesce(unit, '') || ')', '▫\s*([^()▫]+)', 1)'''))} AS caption FROM stat_tables")
def str_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.concat(F.lit("▫ "), "title", F.lit("\n현황 (단위: "), F.coalesce("unit", F.lit("")), F.lit(")"))
    return table(spark, sf_dir, "stat_tables").select("id", L.caption(context).alias("caption"))


def _case(names: dict[str, str], other: str) -> str:
    return "CASE split_part(code, '-', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE '{other}' END"


@query("str_domains", f"SELECT id, {_case(L.DOMAINS, '통계')} AS domain, {_case(L.THEMES, 'blue')} AS theme FROM stat_tables")
def str_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stat_tables").select("id", L.domain(F.col("code")).alias("domain"), L.theme(F.col("code")).alias("theme"))


PLACES = [k for k in X.REGIONS if len(k) > 2]
PLACE_LIST = "[" + ", ".join(f"'{p}'" for p in PLACES) + "]"
PLACE_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in X.REGIONS.items()) + "}"


@query("str_regions", f"SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE {PLACE_MAP}[{PLACE_LIST}[n_nationkey % {len(PLACES)} + 1]] || ', ' || {PLACE_MAP}['서울'] END AS en FROM nation")
def str_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of two region names, every fifth with a name that is none."""
    names = F.array(*[F.lit(p) for p in PLACES])
    first = F.when(F.col("n_nationkey") % 5 == 4, "없는곳").otherwise(names[F.col("n_nationkey") % len(PLACES)])
    return table(spark, sf_dir, "nation").select("n_nationkey", X.translate_region(F.concat(first, F.lit(" , 서울"))).alias("en"))


_CON = L.CONTACT.replace("'", "''")
_SRC = rf"trim(regexp_replace(regexp_replace(regexp_replace(source, '\\', '', 'g'), '^\s*[*＊※ㆍ·-]\s*', ''), '{S}+', ' ', 'g'))"


@query(
    "str_contacts",
    rf"""WITH s AS (SELECT id, {_SRC} AS s FROM stat_tables WHERE source IS NOT NULL)
    SELECT id, list_distinct(list_transform(regexp_extract_all(s, '{_CON}', 1), lambda x: trim(x))).list_sort().array_to_string('|') AS departments,
    list_distinct(list_transform(regexp_extract_all(s, '{_CON}', 0), lambda x: regexp_extract(x, '{_CON}', 2) || ' ' || regexp_extract(x, '{_CON}', 3))).list_sort().array_to_string('|') AS officers,
    list_distinct(list_transform(regexp_extract_all(s, '{L.PHONE}', 0), lambda x: replace(regexp_replace(x, '\s+', '', 'g'), ')', '-'))).list_sort().array_to_string('|') AS phones,
    regexp_replace(regexp_replace(regexp_replace(s, '{L.PHONE}', '', 'g'), '{_CON}', '', 'g'), '^[ *()/,;|-]+|[ *()/,;|-]+$', '', 'g') AS reference FROM s""",
)
def str_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "stat_tables").where("source is not null").select("id", L.contacts(F.col("source")).alias("c"))
    one = lambda k: F.array_join(F.array_sort(f"c.{k}"), "|").alias(k)
    return t.select("id", one("departments"), one("officers"), one("phones"), F.col("c.reference").alias("reference"))


@query(
    "str_terms",
    r"""SELECT id, NOT regexp_matches(text_value, '통\s*계\s*청|회\s*계|계\s*곡') AND regexp_matches(text_value, '(^|[\s/·])계($|[\s/·])') AS total, regexp_matches(text_value, '(^|[^가-힣A-Za-z])합계($|[^가-힣A-Za-z])') AS sum
    FROM stat_table_cells WHERE contains(text_value, '계')""",
)
def str_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "stat_table_cells").where(F.col("text_value").contains("계"))
    return c.select("id", L.has_term(F.col("text_value"), "계").alias("total"), L.has_term(F.col("text_value"), "합계").alias("sum"))


@query(
    "str_punctuation",
    r"""WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, '. ', '..') WHEN 2 THEN replace(text, ',', '`') ELSE text || chr(1) END AS t FROM documents),
    r AS (SELECT doc_id, CASE WHEN regexp_matches(t, '[\x{fffd}\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]') THEN 'broken character' WHEN regexp_matches(t, '[0-9][ㅡㆍ''’`´][0-9]') THEN 'wrong mark between digits' WHEN regexp_matches(t, '[가-힣A-Za-z0-9][,.;:]{2,}[가-힣A-Za-z0-9]') THEN 'doubled mark' END AS reason FROM p)
    SELECT * FROM r WHERE reason IS NOT NULL""",
)
def str_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which three in four are spoilt in one of the ways."""
    k = F.col("doc_id") % 4
    t = F.when(k == 0, F.col("text")).when(k == 1, F.replace("text", F.lit(". "), F.lit(".."))).when(k == 2, F.replace("text", F.lit(","), F.lit("`"))).otherwise(F.concat("text", F.lit("\x01")))
    return table(spark, sf_dir, "documents").select("doc_id", L.punctuation(t).alias("reason")).where("reason is not null")


@query("str_decoded", "SELECT id, title AS title, title || '+%zz' AS broken FROM stat_tables")
def str_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "stat_tables")
    return t.select("id", L.decoded(F.replace(F.url_encode("title"), F.lit("+"), F.lit("%20"))).alias("title"), L.decoded(F.concat("title", F.lit("+%zz"))).alias("broken"))


@query(
    "str_sheet_names",
    r"""WITH b AS (SELECT id, report_id, table_order, substr(regexp_replace(regexp_replace(title, '[\[\]:*?/\\]', '_', 'g'), '^[ '']+|[ '']+$', '', 'g'), 1, 31) AS b FROM stat_tables),
    n AS (SELECT id, CASE WHEN b <> '' THEN b ELSE '통계' END AS b, row_number() OVER (PARTITION BY report_id, CASE WHEN b <> '' THEN b ELSE '통계' END ORDER BY table_order, id) AS k FROM b)
    SELECT id, CASE WHEN k = 1 THEN b ELSE substr(b, 1, 31 - length('_' || k)) || '_' || k END AS name FROM n""",
)
def str_sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "stat_tables").select("id", "report_id", "table_order", L.sheet_base(F.col("title")).alias("base"))
    t = t.withColumn("turn", F.row_number().over(W.partitionBy("report_id", "base").orderBy("table_order", "id")))
    return t.select("id", L.sheet_name(F.col("base"), F.col("turn")).alias("name"))


@query(
    "str_cell_ranges",
    """WITH w AS (SELECT table_id, max(col_index) + 1 + table_id % 800 AS w, max(row_index) + 1 AS h FROM stat_table_cells GROUP BY table_id)
    SELECT table_id, 'A1:' || CASE WHEN w > 702 THEN chr(CAST(65 + (w - 703) // 676 % 26 AS INT)) ELSE '' END || CASE WHEN w > 26 THEN chr(CAST(65 + (w - 27) // 26 % 26 AS INT)) ELSE '' END || chr(CAST(65 + (w - 1) % 26 AS INT)) || h AS cell_range FROM w""",
)
def str_cell_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of each grid, made up to 800 columns wider."""
    w = table(spark, sf_dir, "stat_table_cells").groupBy("table_id").agg((F.max("col_index") + 1 + F.first(F.col("table_id") % 800)).alias("w"), (F.max("row_index") + 1).alias("h"))
    return w.select("table_id", L.cell_range(F.col("h"), F.col("w")).alias("cell_range"))


@query("dat_stated", r"""SELECT id, trim(regexp_extract(c, '단위\s*[:：]\s*([^)）]+)', 1)) AS unit, CASE WHEN regexp_matches(c, '(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})\s*\.?\s*기준') THEN
    CAST(CAST(regexp_extract(c, '(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})\s*\.?\s*기준', 1) AS INT) AS VARCHAR) || '. ' || CAST(regexp_extract(c, '(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})\s*\.?\s*기준', 2) AS INT) || '. ' || CAST(regexp_extract(c, '(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})\s*\.?\s*기준', 3) AS INT) || '.'
    WHEN id % 3 = 0 THEN '제3기: 2020. 1. ~ 2022. 6.' ELSE '' END AS base_date FROM (SELECT id, CASE WHEN id % 3 = 0 THEN '[제3기: ’20. 01. ~ 2022. 6.] (단위: ' || coalesce(unit, '') || ')' ELSE raw_context END AS c FROM stat_tables)""")
def dat_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit and base date out of the contexts, every third of which states a period instead."""
    c = F.when(F.col("id") % 3 == 0, F.concat(F.lit("[제3기: ’20. 01. ~ 2022. 6.] (단위: "), F.coalesce("unit", F.lit("")), F.lit(")"))).otherwise(F.col("raw_context"))
    return table(spark, sf_dir, "stat_tables").select("id", L.stated_unit(c).alias("unit"), L.stated_date(c).alias("base_date"))


@query("dat_temporal", """SELECT o_orderkey, CASE WHEN k = 3 THEN NULL WHEN k = 0 THEN strftime(d, '%Y-%m-%d') WHEN k = 1 THEN year(d) || ' and after' ELSE month(d) || '- through' END AS en
    FROM (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 4 AS k FROM orders)""")
def dat_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in four Korean notations; the last is more than a date."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    y, m, day = (F.concat(f(d).cast("string"), F.lit(u)) for f, u in ((F.year, "년"), (F.month, "월"), (F.day, "일")))
    t = F.when(k == 0, F.concat_ws(" ", y, m, day)).when(k == 1, F.concat(y, F.lit(" 이후"))).when(k == 2, F.concat(m, F.lit(" 까지"))).otherwise(F.concat(y, F.lit(" 주문")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(L.is_temporal(t), L.temporal_english(t)).alias("en"))


@query("dat_display", "SELECT id, CASE WHEN id % 2 = 0 THEN strftime(extracted_at, '%Y-%m-%d') ELSE base_date END AS shown FROM stat_tables")
def dat_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("id") % 2 == 0, F.date_format("extracted_at", "yyyy-MM-dd HH:mm:ss")).otherwise(F.col("base_date"))
    return table(spark, sf_dir, "stat_tables").select("id", L.date_only(t).alias("shown"))


@query("num_display", """SELECT c.id, CASE WHEN x = floor(x) THEN format('{:,}', CAST(x AS BIGINT)) ELSE format('{:,.1f}', x) END || CASE WHEN coalesce(unit, '') IN ('', '-', '%') THEN '' ELSE unit END AS shown
    FROM (SELECT id, table_id, numeric_value AS x FROM stat_table_cells WHERE numeric_value IS NOT NULL) c JOIN stat_tables t ON t.id = c.table_id""")
def num_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "stat_tables").select(F.col("id").alias("table_id"), "unit")
    c = table(spark, sf_dir, "stat_table_cells").where("numeric_value is not null").join(t, "table_id")
    return c.select("id", L.with_unit(F.col("numeric_value"), F.col("unit")).alias("shown"))


@query("num_compact", r"""WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice * power(10, l_linenumber * 2 - 4) AS x FROM lineitem), p AS (SELECT *, CASE WHEN abs(x) >= 1e12 THEN 1e12 WHEN abs(x) >= 1e8 THEN 1e8 WHEN abs(x) >= 1e4 THEN 1e4 ELSE 1 END AS p FROM s)
    SELECT l_orderkey, l_linenumber, regexp_replace(format('{:,.1f}', round(x / p, 1)), '\.0$', '') || CASE p WHEN 1e12 THEN '조' WHEN 1e8 THEN '억' WHEN 1e4 THEN '만' ELSE '' END AS shown FROM p""")
def num_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice") * F.pow(F.lit(10.0), F.col("l_linenumber") * 2 - 4)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", L.compact_korean(x).alias("shown"))


REGION2 = ", ".join(f"'{k}'" for k in X.REGIONS if len(k) == 2)
TOTAL_SQL = r"""CASE WHEN regexp_matches(d, '^소 ?계($|[ (:\[])') OR regexp_matches(d, '(^|[^a-z])sub[ -]?total($|[^a-z])', 'i') THEN 'subtotal'
    WHEN regexp_matches(d, '^(합 ?계|총 ?계)($|[ (:\[])') OR regexp_matches(d, '^계( +(total|sum)($|[^a-z])| *$| *[(:\[])', 'i') OR regexp_matches(d, '^(grand )?total($|[^a-z])', 'i') THEN 'total' END"""


@query("flt_row_roles", f"""WITH {CELLS}, l AS (SELECT table_id, row_index, {D('text_value')} AS d, {K('text_value')} AS k FROM cells WHERE NOT is_header AND col_index = 0), t AS (SELECT *, {TOTAL_SQL} AS total FROM l)
    SELECT table_id, row_index, CASE WHEN total = 'total' THEN 'total' WHEN starts_with(k, '소계') OR contains(k, 'subtotal') THEN 'subtotal' WHEN substr(d, 1, 2) IN ({REGION2}) THEN 'region' WHEN regexp_full_match(k, '[0-9]{{4}}') THEN 'year' WHEN regexp_matches(k, '비율|비중|증감률|율|잔액률') THEN 'ratio' ELSE 'item' END AS role FROM t""")
def flt_row_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(spark, sf_dir).where("not is_header and col_index = 0").select("table_id", "row_index", L.row_role(F.col("text_value")).alias("role"))


@query("flt_column_roles", f"""WITH {CELLS}, h AS (SELECT id, {D('text_value')} AS t, {K('text_value')} AS k FROM cells WHERE is_header)
    SELECT id, CASE WHEN regexp_matches(k, '일자|일시|날짜|기간') OR regexp_matches(t, '\\b(dates?|period|schedule)\\b', 'i') THEN 'date' WHEN regexp_matches(k, '계|합계|총계|소계|total') THEN 'total' WHEN regexp_matches(k, '비율|비중|증감률|율|잔액률|rate|ratio|percent') THEN 'ratio'
    WHEN regexp_matches(t, '\\([a-z]\\s*=', 'i') THEN 'formula' WHEN regexp_matches(t, '\\([a-z]\\s*/\\s*[a-z]', 'i') THEN 'ratio_formula' ELSE 'value' END AS role FROM h""".replace("\\\\", "\\"))
def flt_column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(spark, sf_dir).where("is_header").select("id", L.column_role(X.display(F.col("text_value"))).alias("role"))


@query("flt_label_kinds", f"""WITH {CELLS}, h AS (SELECT id, {D('text_value')} AS d, {K('text_value')} AS k, text_value FROM cells WHERE is_header OR col_index = 0)
    SELECT id, {TOTAL_SQL} AS total, regexp_matches(k, '(1인|인|건|개|명|회|가구|세대|대|기관)당') OR NOT regexp_matches(d, '[가-힣]') AND regexp_matches(d, '(^|[^a-z])per (person|capita|case|task|item|household|organization|unit)($|[^a-z])', 'i') AS per_unit,
    regexp_matches(d, '평균') OR regexp_matches(d, '(^|[^a-z])(average|mean)($|[^a-z])', 'i') AS average, regexp_matches(k, '증감률|증감율|증가율|증가률|감소율|감소률|성장률|growthrate') AS growth, regexp_matches(k, '증감|증가|감소|change') AND NOT regexp_matches(k, '증감률|증감율|증가율|증가률|감소율|감소률|성장률|growthrate') AS change_amount FROM h WHERE text_value IS NOT NULL""")
def flt_label_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.display(F.col("text_value"))
    c = cells_of(spark, sf_dir).where("(is_header or col_index = 0) and text_value is not null")
    return c.select("id", L.total_kind(t).alias("total"), L.is_per_unit(t).alias("per_unit"), L.is_average(t).alias("average"), L.is_growth(t).alias("growth"), L.is_change_amount(t).alias("change_amount"))


@query("flt_count_units", f"SELECT id, NOT regexp_matches(unit, '[,%/·･]') AND {K('unit')} IN ('명', '개', '개소', '건', '회', '종', '곳', '대', '가구', '세대', '필지', '동') AS counts FROM stat_tables WHERE unit IS NOT NULL")
def flt_count_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "stat_tables").where("unit is not null").select("id", L.is_count_unit(F.col("unit")).alias("counts"))
