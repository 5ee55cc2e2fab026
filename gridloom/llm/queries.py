"""The named queries of the text subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.canonical import p3_found
from gridloom.llm.leakage import p8_found, p8_leaks
from gridloom.llm.names import p4_clusters, p4_found, p4_links
from gridloom.llm.plain_text import not_plain
from gridloom.llm.repetition import p9_found, p9_host_lines, p9_lines, p9_share
from gridloom.llm.tokens import p7_ids
from gridloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("stat_table_cells", "id", "text_value"), ("stat_tables", "id", "title_en"), ("official_translation_glossary", "entry_id", "source"))
    return reduce(DataFrame.unionAll, (not_plain(table(spark, sf_dir, t), f"{t}.{c}", i, c) for t, i, c in fields))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p4_clusters": p4_clusters,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
    "p9_share": p9_share,
    "p9_lines": p9_lines,
    "p9_host_lines": p9_host_lines,
}
# White space as Java's (?U)\s knows it.
BLANKS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ORACLE: dict[str, str] = {
    "p9_lines": f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text FROM documents),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL),
n AS (SELECT doc_id, host, length(line) AS size, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '{BLANKS}', ' ', 'g')) AS plain FROM l),
p AS (SELECT doc_id, host, plain, count(*) AS lines, sum(size) AS chars FROM n WHERE plain <> '' GROUP BY ALL),
gone AS (SELECT p.host, p.plain FROM p JOIN (SELECT host, count(*) AS n FROM d GROUP BY host) h USING (host) GROUP BY p.host, p.plain, h.n HAVING count(*) > 20 AND count(*) > 0.05 * h.n),
x AS (SELECT p.*, g.plain IS NOT NULL AS out FROM p LEFT JOIN gone g ON p.host = g.host AND p.plain = g.plain),
s AS (SELECT doc_id, sum(lines) AS lines, sum(CASE WHEN out THEN lines ELSE 0 END) AS removed, sum(chars) AS chars, sum(CASE WHEN out THEN 0 ELSE chars END) AS chars_left FROM x GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(lines, 0) AS BIGINT) AS lines, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(chars, 0) AS BIGINT) AS chars, CAST(coalesce(chars_left, 0) AS BIGINT) AS chars_left,
coalesce(chars, 0) > 0 AND chars_left < 0.5 * chars AS rejected FROM d LEFT JOIN s USING (doc_id)""",
}
ORACLE["p9_host_lines"] = ORACLE["p9_lines"].replace("HAVING count(*) > 20 AND", "HAVING count(*) > 2 AND")
