"""Review of texts by dictionaries: candidates, bilingual pairs, ranked lookups, memoised decisions; a model is a plug that is off by default."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import labels as L
from gridloom.functions import numeric as N
from gridloom.functions import text as X
from gridloom.operators.crosstable import base_code
from gridloom.operators.relational import contains_terms, first_holding, first_n, insert_ignore
from gridloom.session import cut, lookup

# How much an entry's status counts (the first one most), and the ranks that may settle a pair.
STATUS_ORDER = ("rejected", "quarantined", "approved", "official_verified", "llm_verified", "official_name_only", "llm_reviewed", "reference")
TRUSTED = ("approved", "official_verified", "llm_verified", "llm_reviewed")
SPELLING = {"잔액율": "잔액률", "진행율": "진행률", "Claasification": "Classification", "Claasifi-cation": "Classification", "Ele7ction": "Election", "Nuber": "Number"}


def status_rank(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, F.lit(i)) for i, s in enumerate(STATUS_ORDER)], F.lit(len(STATUS_ORDER)))


def glossary_names(glossary: DataFrame) -> DataFrame:
    """entry_id, key, target, status: one row per source and alias of an entry, by comparison key."""
    names = F.array_distinct(F.transform(F.concat(F.array("source"), F.coalesce("aliases", F.array().cast("array<string>"))), X.normalize))
    return glossary.select("entry_id", "target", "status", F.explode(names).alias("key")).where("key <> ''")


def exact_lookup(texts: DataFrame, text: str, glossary: DataFrame, most: int = 8) -> DataFrame:
    """texts with the entries whose source or alias equals the text, at most `most` by rank."""
    j = texts.withColumn("key", X.normalize(F.col(text))).join(glossary_names(glossary), "key")
    return first_n(j, [c for c in texts.columns], [status_rank(F.col("status")), F.desc("entry_id")], most).drop("key")


def contained_lookup(texts: DataFrame, text: str, glossary: DataFrame, id_column: str, most: int = 16) -> DataFrame:
    """texts with the entries whose name of two characters or more occurs in them, at most `most` by rank, longer names first."""
    t = texts.select(id_column, X.normalize(F.col(text)).alias("__t"))
    j = contains_terms(t, "__t", glossary_names(glossary), "key").groupBy(id_column, "entry_id", "status").agg(F.max(F.length("key")).alias("size"))
    return first_n(j, [id_column], [status_rank(F.col("status")), F.desc("size"), F.desc("entry_id")], most)


def harvest(texts: DataFrame, text: str) -> DataFrame:
    """ko, en, n: bilingual pairs that texts hold, with how often."""
    p = texts.select(X.bilingual_pair(F.col(text)).alias("p")).where("p is not null").select("p.*")
    return p.groupBy(F.col("ko"), F.col("en")).agg(F.count("*").alias("n"))


def decide(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """ko, en, decision: normal if a trusted entry has the pair; else open. A mismatch is never a finding by itself."""
    g = glossary.where(F.col("status").isin(*TRUSTED))
    names = glossary_names(g).select(F.col("key").alias("ko_key"), X.normalize(F.col("target")).alias("en_key")).distinct().withColumn("hit", F.lit(True))
    p = pairs.withColumns({"ko_key": X.normalize(F.col("ko")), "en_key": X.normalize(F.col("en"))}).join(names, ["ko_key", "en_key"], "left")
    return p.select("ko", "en", F.when(F.col("hit"), "normal").otherwise("open").alias("decision"))


def candidates(cells: DataFrame) -> DataFrame:
    """table_id, row_index, col_index, kind, value of texts to review: spelling for every text of a language, translation where there is a pair."""
    c = cells.where(X.has_language(F.col("text_value"))).select("table_id", "row_index", "col_index", F.explode(X.chunks(F.col("text_value"))).alias("value"))
    kinds = F.when(X.bilingual_pair(F.col("value")).isNotNull(), F.array(F.lit("spelling"), F.lit("translation"))).otherwise(F.array(F.lit("spelling")))
    return c.select("table_id", "row_index", "col_index", F.explode(kinds).alias("kind"), "value").distinct()


def format_candidates(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """table_id, row_index, col_index, reason: malformed numbers, judged by their column's other texts and the table's unit, and suspicious punctuation."""
    data = cells.where("not is_header and text_value is not null")
    c = data.join(data.groupBy("table_id", "col_index").agg(*N.peers(F.col("text_value"))), ["table_id", "col_index"]).join(tables.select(F.col("id").alias("table_id"), "unit"), "table_id", "left")
    reason = F.coalesce(N.anomaly(F.col("text_value"), F.col("unit"), F.col("numbers"), F.col("grouped"), F.col("whole")), F.when(X.has_language(F.col("text_value")), L.punctuation(F.col("text_value"))))
    return c.select("table_id", "row_index", "col_index", reason.alias("reason")).where("reason is not null")


def spelling(cells: DataFrame, terms: dict[str, str] = SPELLING, most: int = 10) -> DataFrame:
    """table_id, row_index, col_index, found, expected: known misspellings, at most `most` of a table."""
    pairs = F.array(*[F.struct(F.lit(k).alias("found"), F.lit(v).alias("expected")) for k, v in terms.items()])
    hits = F.filter(pairs, lambda p: F.col("text_value").contains(p["found"]))
    c = cells.where(F.col("text_value").rlike("|".join(terms))).select("table_id", "row_index", "col_index", F.explode(hits).alias("h")).select("table_id", "row_index", "col_index", "h.*")
    return first_n(c, ["table_id"], [F.col("row_index"), F.col("col_index"), F.col("found")], most)


def from_cache(work: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work with the cached decision of its fingerprint, work that has none)."""
    return work.join(cache.select("fingerprint", "decision"), "fingerprint"), work.join(cache.select("fingerprint"), "fingerprint", "left_anti")


def learn(glossary: DataFrame, decided: DataFrame) -> DataFrame:
    """Pairs decided normal that the glossary doesn't hold (by source and target), as entries to append."""
    new = decided.where("decision = 'normal'").select(F.col("ko").alias("source"), F.col("en").alias("target"), F.lit("llm_verified").alias("status")).distinct()
    return insert_ignore(glossary.select("source", "target", "status"), new, ["source", "target"])


def review(work: DataFrame, client: Callable[[], Callable[[list[str]], list[str]]], batch: int = 16, tries: int = 3) -> DataFrame:
    """fingerprint, decision by a model: `client()` is made once a task and given up to `batch` texts at a time, each of which it must answer.

    A batch that fails or is answered in part is tried again, then text by text; a text that still has no answer needs review.
    """

    def answered(ask: Callable[[list[str]], list[str]], texts: list[str]) -> list[str] | None:
        for _ in range(tries):
            try:
                got = list(ask(texts))
            except Exception:  # noqa: BLE001 - whatever the model's side throws, the job goes on
                continue
            if len(got) == len(texts):
                return got
        return None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = client()
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                got = answered(ask, part)
                out += got if got is not None else [(answered(ask, [t]) or ["needs review"])[0] for t in part]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["fingerprint", "decision"])

    return work.select("fingerprint", F.col("value").cast("string")).mapInArrow(kernel, "fingerprint string, decision string")


def no_model() -> Callable[[list[str]], list[str]]:
    """The default client: every text stays open."""
    return lambda texts: ["open"] * len(texts)


def preview(tables: DataFrame, cells: DataFrame, table_id: int, client: Callable[[], Callable[[list[str]], list[str]]] = no_model) -> DataFrame:
    """value, decision of the texts of one table, without anything being kept; reads that table's cells alone."""
    t = cells.join(tables.where(F.col("id") == table_id).select(F.col("id").alias("table_id")), "table_id", "left_semi")
    work = candidates(t).select("value").distinct().withColumn("fingerprint", X.fingerprint(F.col("value")))
    return work.join(review(work, client), "fingerprint").select("value", "decision")


def text_candidates(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """table_id, place, row_index, col_index, kind, value of all texts to review: titles, sections, captions and cells, in pieces."""
    none = F.lit(None).cast("int")
    fields = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), v.alias("value")) for k, v in (("title", F.concat_ws("\n", "title", F.nullif("title_en", F.lit("")))), ("section", F.concat_ws("\n", F.nullif("section_title", F.lit("")), F.nullif("section_title_en", F.lit("")))), ("caption", L.caption(F.coalesce("raw_context", F.lit("")))))]))
    t = tables.select(F.col("id").alias("table_id"), fields.alias("f")).select("table_id", "f.place", none.alias("row_index"), none.alias("col_index"), "f.value")
    every = t.unionByName(cells.select("table_id", F.lit("cell").alias("place"), "row_index", "col_index", F.col("text_value").alias("value"))).where(X.has_language(F.col("value")))
    every = every.withColumn("value", F.explode(X.chunks(F.col("value"))))
    kinds = F.when(X.bilingual_pair(F.col("value")).isNotNull(), F.array(F.lit("spelling"), F.lit("translation"))).otherwise(F.array(F.lit("spelling")))
    return every.withColumn("kind", F.explode(kinds)).distinct()


def other_reports(pairs: DataFrame, key: list[str], report: str = "report_id") -> DataFrame:
    """pairs with n_other: in how many other reports the same key stands, so that a text doesn't vouch for itself."""
    n = pairs.select(*key, report).distinct().groupBy(*key).agg(F.count("*").alias("__n"))
    return pairs.join(n, key).withColumn("n_other", F.col("__n") - 1).drop("__n")


def regions(texts: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """texts with ko, en, expected, decision: what a region list says in English against the names (source, target).

    normal if the text has the right English, mismatch if it has another, suggest if it has none; texts with a name that
    isn't listed are left out.
    """
    t = texts.withColumn("__id", F.monotonically_increasing_id())
    first = r"(?s)^([^A-Za-z]*?[가-힣][^A-Za-z]*?)[\s,;/]*([A-Za-z].*)?$"
    t = t.where(F.col(text).rlike(first)).withColumns({"ko": F.trim(F.regexp_replace(F.regexp_extract(text, first, 1), r"\s+", " ")), "en": F.nullif(F.trim(F.regexp_extract(text, first, 2)), F.lit(""))})
    n = names.select(F.regexp_replace("source", X.WS, "").alias("__k"), F.col("target").alias("__t")).groupBy("__k").agg(F.min("__t").alias("__t"))
    parts = t.select("__id", F.posexplode(F.filter(F.split("ko", r"\s*[,;]\s*"), lambda x: F.trim(x) != "")).alias("__pos", "__name")).withColumn("__k", F.regexp_replace("__name", X.WS, ""))
    found = parts.join(n, "__k", "left").groupBy("__id").agg(F.count_if(F.col("__t").isNull()).alias("__open"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__t"))), lambda x: x["__t"]), ", ").alias("expected")).where("__open = 0")
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    decision = F.when(F.col("en").isNull(), "suggest").when(key(F.col("en")) == key(F.col("expected")), "normal").otherwise("mismatch")
    return t.join(found.drop("__open"), "__id").drop("__id").withColumn("decision", decision)


def plausible(found: DataFrame) -> DataFrame:
    """found (source_text, value, expected) with `refused`: why a model's proposal isn't taken, null if it is.

    The value must still stand in its source; the proposal must differ from it by more than blanks and case, hold the
    same numbers, no placeholder and no other script, and be of like length.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, X.WS, ""))
    numbers = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))
    v, e = F.col("value"), F.coalesce("expected", F.lit(""))
    return found.withColumn("refused", F.when(~F.coalesce(F.col("source_text").contains(v), F.lit(False)), "source has changed").when(F.trim(e) == "", "nothing proposed").when(bare(e) == bare(v), "nothing differs").when(e.rlike("<NUM>|<[A-Z]+>|\\{\\{"), "placeholder left").when(numbers(e) != numbers(v), "numbers differ").when(X.has_hangul(e) != X.has_hangul(v), "another script").when((F.length(e) > 2 * F.length(v) + 20) | (F.length(v) > 2 * F.length(e) + 20), "another length"))


def settled(findings: DataFrame) -> DataFrame:
    """findings (current_value, expected_value, status) with those that call for no action set to normal, and why: the same words in any order, the same after cleaning, or dates that only are written otherwise."""
    c, e = F.col("current_value"), F.col("expected_value")
    why = F.when(X.review_text(c) == X.review_text(e), "same text").when(X.same_words(c, e), "same words").when(L.is_temporal(c) & (F.regexp_replace(e, "[^0-9]", "") == F.regexp_replace(L.temporal_english(c), "[^0-9]", "")), "same date")
    return findings.withColumn("why", F.when(F.col("status") != "정상", why)).withColumn("status", F.when(F.col("why").isNotNull(), "정상").otherwise(F.col("status")))


def placed(marked: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """marked (mark_id, code, text, col_index or null) with place (cell, field or none), table_id, row_index, col_index.

    First the cells of the tables of its code, or of a part of it: equal texts before texts that hold it, in its column
    if it names one, the first in reading order. What is left is looked for in the tables' titles, sources and notes.
    """
    key = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), X.WS, ""))
    m = cut(marked.select("mark_id", "code", key(F.col("text")).alias("k"), F.col("col_index").cast("int").alias("want")).where("k <> ''"))
    names = F.explode(F.array_distinct(F.array("code", base_code(F.col("code"))))).alias("code")
    t = cut(tables.select(F.col("id").alias("table_id"), names, key(F.concat_ws("|", "title", "title_en", "source", "note")).alias("fields")).where("code is not null"))
    c = lookup(cells.select("table_id", "row_index", "col_index", key(F.col("text_value")).alias("t")).where("t <> ''"), t.select("table_id", "code"), ["table_id"], "t")
    c = c.where("code is not null").select("code", F.col("col_index").alias("want"), "t", F.struct("table_id", "row_index", "col_index").alias("at"))
    ways = [(m.where("want is not null"), ["code", "want"]), (m.where("want is null"), ["code"])]
    ways = [w for w in ways if not w[0].isEmpty()] or ways[:1]
    hits = [own.join(first_holding(own, c, on), [*on, "k"]).select("mark_id", F.struct("n", "at").alias("b")) for own, on in ways]
    best = cut(reduce(DataFrame.unionAll, hits).groupBy("mark_id").agg(F.min("b").alias("b")).select("mark_id", F.lit("cell").alias("place"), "b.at.*"))
    rest = m.join(best, "mark_id", "left_anti")
    fields = t.groupBy("code", "fields").agg(F.min("table_id").alias("table_id"))
    held = rest.select("code", "k").distinct().join(fields, "code").where(F.col("fields").contains(F.col("k"))).groupBy("code", "k").agg(F.min("table_id").alias("table_id"))
    rest = rest.join(held, ["code", "k"]).groupBy("mark_id").agg(F.min("table_id").alias("table_id")).withColumn("place", F.lit("field"))
    both = best.unionByName(rest, allowMissingColumns=True)
    return both.unionByName(marked.select("mark_id").join(both, "mark_id", "left_anti").withColumn("place", F.lit("none")), allowMissingColumns=True)


def synchronised(marked: DataFrame, checks: DataFrame) -> DataFrame:
    """code, text, marks, checks, status: every marked text once, with how often it was marked and checked: open, checked or more checks than marks."""
    m = marked.groupBy("code", F.trim("text").alias("text")).agg(F.count("*").alias("marks"))
    c = checks.groupBy("code", F.trim("text").alias("text")).agg(F.count("*").alias("checks"))
    j = m.join(c, ["code", "text"], "full").na.fill(0, ["marks", "checks"])
    return j.withColumn("status", F.when(F.col("checks") < F.col("marks"), "open").when(F.col("checks") == F.col("marks"), "checked").otherwise("stale"))


def audited(glossary: DataFrame, official: DataFrame, terms: dict[str, str] = SPELLING) -> DataFrame:
    """glossary with `verdict`: quarantined if it holds a known misspelling, verified if an official entry has the same pair, contradicted if one has another English for its source, else open."""
    wrong = F.col("source").rlike("|".join(terms)) | F.col("target").rlike("|".join(terms))
    o = official.select(L.source_key(F.col("source")).alias("__s"), L.target_key(F.col("target")).alias("__t")).distinct()
    g = glossary.withColumns({"__s": L.source_key(F.col("source")), "__t": L.target_key(F.col("target"))})
    same = o.withColumn("__same", F.lit(True))
    known = o.select("__s").distinct().withColumn("__known", F.lit(True))
    g = g.join(same, ["__s", "__t"], "left").join(known, "__s", "left")
    verdict = F.when(F.coalesce(wrong, F.lit(False)), "quarantined").when(F.col("__same"), "verified").when(F.col("__known"), "contradicted").otherwise("open")
    return g.withColumn("verdict", verdict).drop("__s", "__t", "__same", "__known")


def rebuilt(tables: DataFrame, changes: DataFrame) -> DataFrame:
    """table_id, scopes: what must be computed again. changes: scope (report, code, table), value, what (calculation, language or marks); a code means its parts and everything below it."""
    t = tables.select(F.col("id").alias("table_id"), F.col("report_id").cast("string").alias("report"), base_code(F.col("code")).alias("base"), F.col("id").cast("string").alias("own"))
    c = changes.select("scope", F.col("value").cast("string").alias("value"), "what")
    # A base code and all above it, so that a change of any of these is found by equality.
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("base", "-"))), lambda n: F.array_join(F.slice(F.split("base", "-"), F.lit(1), n), "-"))
    keys = t.select("table_id", F.explode(F.concat(F.array(F.struct(F.lit("report").alias("scope"), F.col("report").alias("value")), F.struct(F.lit("table").alias("scope"), F.col("own").alias("value"))), F.transform(up, lambda v: F.struct(F.lit("code").alias("scope"), v.alias("value"))))).alias("k")).select("table_id", "k.*")
    return keys.join(c, ["scope", "value"]).groupBy("table_id").agg(F.array_sort(F.collect_set("what")).alias("scopes"))


def refreshed(seed: DataFrame, official: DataFrame, harvested: DataFrame) -> DataFrame:
    """source, target, status, category, n: one glossary from three lists (source, target; harvested also n, how often it stands in the yearbook).

    Of equal pairs (by their keys) the best status counts: official before seed before what was only found; n adds up.
    """
    parts = [df.select("source", "target", F.lit(status).alias("status"), (F.col("n") if "n" in df.columns else F.lit(1)).cast("long").alias("n")) for df, status in ((official, "official_verified"), (seed, "approved"), (harvested, "reference"))]
    rank = F.when(F.col("status") == "official_verified", 0).when(F.col("status") == "approved", 1).otherwise(2)
    x = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("source is not null and target is not null")
    g = x.groupBy(L.source_key(F.col("source")).alias("__s"), L.target_key(F.col("target")).alias("__t")).agg(F.min(F.struct(rank.alias("r"), "source", "target", "status")).alias("b"), F.sum("n").alias("n"))
    return g.select("b.source", "b.target", "b.status", L.category(F.col("b.source"), F.col("b.target")).alias("category"), "n")
