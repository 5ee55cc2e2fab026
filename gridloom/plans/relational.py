"""Queries of the relational surface: joins, aggregates, windows, sets and changes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import relational as R
from gridloom.plans.registry import query
from gridloom.session import table

T = table


@query("join_inner", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_inner(s: SparkSession, d: str) -> DataFrame:
    o = T(s, d, "orders").select("o_custkey", "o_totalprice").join(T(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    per = o.groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    return per.join(T(s, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("orders").alias("orders"), F.round(F.sum("total"), 2).alias("total"))


@query("join_left", "SELECT t.id, t.code, g.target FROM stat_tables t LEFT JOIN (SELECT source, min(target) AS target FROM official_translation_glossary GROUP BY source) g ON t.section_title = g.source")
def join_left(s: SparkSession, d: str) -> DataFrame:
    g = T(s, d, "official_translation_glossary").groupBy("source").agg(F.min("target").alias("target"))
    return T(s, d, "stat_tables").select("id", "code", F.col("section_title").alias("source")).join(g, "source", "left").select("id", "code", "target")


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "customer").select("c_custkey").join(T(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "customer").select("c_custkey").join(T(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("join_anti_rare", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def join_anti_rare(s: SparkSession, d: str) -> DataFrame:
    """Parts never ordered in a large number."""
    return T(s, d, "part").select("p_partkey").join(T(s, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("join_contains_many", "SELECT t.id, g.entry_id FROM stat_tables t JOIN official_translation_glossary g ON length(g.source) >= 2 AND contains(t.title, g.source)")
def join_contains_many(s: SparkSession, d: str) -> DataFrame:
    """The way for dictionaries too large to be broadcast, by pairs of characters."""
    g = T(s, d, "official_translation_glossary").where("source is not null").select("entry_id", "source")
    return R.contains_terms(T(s, d, "stat_tables").select("id", "title"), "title", g, "source", limit_bytes=-1).select("id", "entry_id")


@query("join_null_safe", "SELECT a.doc_id, b.n AS peers FROM documents a JOIN (SELECT table_code, lang, count(*) AS n FROM documents GROUP BY ALL) b ON a.table_code IS NOT DISTINCT FROM b.table_code AND a.lang IS NOT DISTINCT FROM b.lang")
def join_null_safe(s: SparkSession, d: str) -> DataFrame:
    x = T(s, d, "documents").select("doc_id", "table_code", "lang")
    n = x.groupBy("table_code", "lang").agg(F.count("*").alias("peers")).withColumnsRenamed({"table_code": "tc", "lang": "l"})
    return x.join(n, x.table_code.eqNullSafe(n.tc) & x.lang.eqNullSafe(n.l)).select("doc_id", "peers")


@query("join_contains", "SELECT t.id, g.entry_id FROM stat_tables t JOIN official_translation_glossary g ON contains(t.title, g.source) WHERE length(g.source) >= 2")
def join_contains(s: SparkSession, d: str) -> DataFrame:
    g = T(s, d, "official_translation_glossary").select("entry_id", "source")
    return R.contains_terms(T(s, d, "stat_tables").select("id", "title"), "title", g, "source").select("id", "entry_id")


@query("join_derived_latest", "SELECT t.id FROM stat_tables t JOIN (SELECT code, max(report_id) AS report_id FROM stat_tables GROUP BY code) m USING (code, report_id)")
def join_derived_latest(s: SparkSession, d: str) -> DataFrame:
    x = T(s, d, "stat_tables").select("id", "code", "report_id")
    return R.latest(x, ["code"], ["report_id", "id"]).select("id")


@query("join_nearest", "WITH e AS (SELECT min(event_id) AS event_id, user_id AS k, CAST(epoch(ts) AS BIGINT) AS p FROM events GROUP BY user_id, p), o AS (SELECT o_orderkey, o_custkey AS k, CAST(epoch(o_orderdate) AS BIGINT) + 820454400 AS p FROM orders) SELECT o_orderkey, event_id FROM o JOIN e USING (k) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(e.p - o.p), e.p) = 1")
def join_nearest(s: SparkSession, d: str) -> DataFrame:
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    e = T(s, d, "events").select("event_id", F.col("user_id").alias("k"), seconds("ts").alias("p")).groupBy("k", "p").agg(F.min("event_id").alias("event_id"))
    o = T(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), (seconds("o_orderdate") + 820454400).alias("q"))
    return R.closest(o, e, ["k"], "q", "p", ["event_id"]).select("o_orderkey", "event_id")


@query("agg_conditional", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, max(event_id) AS last_id, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_conditional(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.max("event_id").alias("last_id"), F.count_distinct("user_id").alias("users"))


@query("agg_concat", "SELECT report_id, min(unit) AS first_unit, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM stat_tables GROUP BY report_id")
def agg_concat(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "stat_tables").groupBy("report_id").agg(F.min("unit").alias("first_unit"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))


@query("agg_distinct_groups", "SELECT count(*) AS n FROM (SELECT DISTINCT report_id, domain, section_title FROM stat_tables)")
def agg_distinct_groups(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "stat_tables").select("report_id", "domain", "section_title").distinct().agg(F.count("*").alias("n"))


@query("agg_median_mad", "WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY event_type) SELECT event_type, round(any_value(med), 6) AS med, round(median(abs(value - med)), 6) AS mad FROM events JOIN m USING (event_type) GROUP BY event_type")
def agg_median_mad(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("event_type", "value")
    m = e.groupBy("event_type").agg(F.median("value").alias("med"))
    return e.join(m, "event_type").groupBy("event_type").agg(F.round(F.first("med"), 6).alias("med"), F.round(F.median(F.abs(F.col("value") - F.col("med"))), 6).alias("mad"))


@query("agg_next_attempt", "SELECT user_id, coalesce(max(event_id) FILTER (WHERE event_type = 'error'), 0) + 1 AS next_attempt FROM events GROUP BY user_id")
def agg_next_attempt(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "events").groupBy("user_id").agg((F.coalesce(F.max(F.when(F.col("event_type") == "error", F.col("event_id"))), F.lit(0)) + 1).alias("next_attempt"))


@query("agg_latest_per_key", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def agg_latest_per_key(s: SparkSession, d: str) -> DataFrame:
    return R.latest(T(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query("agg_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def agg_rollup(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).join(T(s, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    return c.rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))


@query("agg_pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def agg_pivot(s: SparkSession, d: str) -> DataFrame:
    p = T(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("o_orderpriority", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in "FOP"])


@query("agg_correlated_count", "SELECT id, (SELECT count(*) FROM stat_table_cells c WHERE c.table_id = t.id AND c.is_header) AS headers FROM stat_tables t")
def agg_correlated_count(s: SparkSession, d: str) -> DataFrame:
    c = T(s, d, "stat_table_cells").where("is_header").groupBy("table_id").agg(F.count("*").alias("headers"))
    return T(s, d, "stat_tables").select(F.col("id").alias("table_id")).join(c, "table_id", "left").select(F.col("table_id").alias("id"), F.coalesce("headers", F.lit(0)).alias("headers"))


@query("win_lag_change", "SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS change FROM orders")
def win_lag_change(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return T(s, d, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("change"))


@query("win_started", "SELECT event_id, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS started FROM events")
def win_started(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return T(s, d, "events").select("event_id", F.max(F.col("event_type") == "purchase").over(w).alias("started"))


@query("win_sections", "SELECT event_id, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS section FROM events")
def win_sections(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return T(s, d, "events").select("event_id", F.count_if(F.col("event_type") == "signup").over(w).alias("section"))


@query("win_duplicate_codes", "SELECT id, base || CASE WHEN n > 1 THEN ' 표' || n ELSE '' END AS code FROM (SELECT id, regexp_replace(code, '\\s+표\\s*[0-9]+$', '') AS base, row_number() OVER (PARTITION BY report_id, regexp_replace(code, '\\s+표\\s*[0-9]+$', '') ORDER BY table_order, id) AS n FROM stat_tables)".replace("\\\\", "\\"))
def win_duplicate_codes(s: SparkSession, d: str) -> DataFrame:
    from gridloom.operators.crosstable import base_code

    t = T(s, d, "stat_tables").select("id", "report_id", "table_order", base_code(F.col("code")).alias("base"))
    n = F.row_number().over(W.partitionBy("report_id", "base").orderBy("table_order", "id"))
    return t.withColumn("n", n).select("id", F.when(F.col("n") > 1, F.concat("base", F.lit(" 표"), F.col("n").cast("string"))).otherwise(F.col("base")).alias("code"))


@query("top_first_n", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_first_n(s: SparkSession, d: str) -> DataFrame:
    return R.first_n(T(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("top_k_report", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 16")
def top_k_report(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(16)


@query("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "customer").select(F.col("c_nationkey").alias("k")).unionAll(T(s, d, "supplier").select("s_nationkey"))


@query("set_distinct_pairs", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def set_distinct_pairs(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("set_overlap", "SELECT owner_id, len(list_intersect(coalesce(a, []), coalesce(b, []))) AS shared, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS only_a FROM (SELECT owner_id, list_distinct(officers) AS a, list_distinct(string_split(officer_raw, ' ')) AS b FROM reference_owners)")
def set_overlap(s: SparkSession, d: str) -> DataFrame:
    e = F.array().cast("array<string>")
    x = T(s, d, "reference_owners").select("owner_id", F.coalesce("officers", e).alias("a"), F.coalesce(F.split("officer_raw", " "), e).alias("b"))
    return x.select("owner_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.size(F.array_except("a", "b")).cast("long").alias("only_a"))


OLD, NEW = "event_type <> 'click'", "event_type in ('click', 'view')"


@query("dml_upsert", f"SELECT event_id, value * 2 AS value FROM events WHERE {NEW} UNION ALL SELECT event_id, value FROM events WHERE {OLD} AND NOT ({NEW})")
def dml_upsert(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("event_id", "value")
    return R.upsert(e.where(OLD), e.where(NEW).withColumn("value", F.col("value") * 2), ["event_id"])


@query("dml_insert_ignore", f"SELECT event_id FROM events WHERE {NEW} AND NOT ({OLD})")
def dml_insert_ignore(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("event_id")
    return R.insert_ignore(e.where(OLD), e.where(NEW), ["event_id"])


@query("dml_update_delete", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'reviewed' ELSE event_type END AS event_type FROM events WHERE value IS NULL OR value <= 90")
def dml_update_delete(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("event_id", "event_type", "value")
    return R.delete_where(R.update_where(e, F.col("event_type") == "error", {"event_type": F.lit("reviewed")}), F.col("value") > 90).select("event_id", "event_type")


@query("json_tolerant", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_tolerant(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))
