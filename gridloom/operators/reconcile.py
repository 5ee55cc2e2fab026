"""Reconciliation of lists: titles matched across lists, persons resolved in a directory, sets compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.operators.relational import closest, first_n


def _lettered(df: DataFrame) -> DataFrame:
    """df (block, key) with n letters and `letters`: its letters, each with which of its kind it is, so that a letter counts as often as it stands there."""
    upto = lambda i: F.substring(F.col("key"), F.lit(1), i)
    one = lambda i: F.substring(F.col("key"), i, F.lit(1))
    which = lambda i: F.length(upto(i)) - F.length(F.replace(upto(i), one(i), F.lit("")))
    return df.withColumn("n", F.length("key")).withColumn("letters", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(one(i), which(i).cast("string"))))


def similar_titles(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """block, key, rkey, similarity of all pairs of distinct keys of a block that are at least so similar.

    The similarity is twice the letters matched over all letters, so pairs share at least least * n / (2 - least) of n
    letters: each side's rarest letters, as many as leave fewer than that, must have one in common (prefix filter), and
    all letters in common bound the similarity before it is reckoned. No similar pair is missed.
    """
    l, r = (_lettered(x.select("block", "key").where("key <> ''").distinct()) for x in (left, right))
    seen = l.unionAll(r).select(F.explode("letters").alias("letter")).groupBy("letter").agg(F.count("*").alias("f"))

    def rare(x: DataFrame) -> DataFrame:
        e = x.select("block", "key", "n", F.explode("letters").alias("letter")).join(seen, "letter")
        e = e.withColumn("place", F.row_number().over(W.partitionBy("block", "key").orderBy("f", "letter")))
        return e.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * (least / (2 - least)) - 1e-9) + 1).select("block", "key", "letter")

    near = rare(l).join(rare(r).withColumnRenamed("key", "rkey"), ["block", "letter"]).select("block", "key", "rkey").distinct()
    near = near.join(l, ["block", "key"]).join(r.withColumnsRenamed({"key": "rkey", "n": "rn", "letters": "rletters"}), ["block", "rkey"])
    near = near.where(2 * F.size(F.array_intersect("letters", "rletters")) >= least * (F.col("n") + F.col("rn")) - 1e-9)
    return near.select("block", "key", "rkey", X.sequence_ratio(F.col("key"), F.col("rkey")).alias("similarity")).where(F.col("similarity") >= least)


def match_titles(left: DataFrame, right: DataFrame, least: float = 0.58, least_combined: float = 0.61, sure: float = 0.78) -> DataFrame:
    """left_id, right_id, method, score. left: left_id, block, title, pos; right: right_id, block, title, pos (positions from 0 to 1).

    Within a block (a year). Equal titles: the nearest by position. Else the best of 0.9 * similarity + 0.1 * (1 -
    distance) among all similar titles, of each of which the row nearest by position counts.
    """
    l = left.withColumn("key", X.normalize(F.col("title")))  # noqa: E741
    r = right.withColumn("key", X.normalize(F.col("title")))
    places = r.groupBy("block", "key", "pos").agg(F.min("right_id").alias("right_id"))
    same = closest(l.select("left_id", "block", "key", "pos"), places, ["block", "key"], "pos", "pos", ["right_id"])
    same = same.select("left_id", "right_id", F.lit("same title").alias("method"), F.lit(1.0).alias("score"))
    rest = l.join(same.select("left_id"), "left_id", "left_anti").select("left_id", "block", "key", "pos")
    pairs = similar_titles(rest, r, least)
    s = closest(rest.join(pairs, ["block", "key"]), places.withColumnRenamed("key", "rkey"), ["block", "rkey"], "pos", "pos", ["right_id"])
    s = s.withColumn("score", 0.9 * F.col("similarity") + 0.1 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("pos") - F.col("nearest_pos"))))
    best = first_n(s.where(F.col("score") >= least_combined), ["left_id"], [F.desc("score"), F.col("right_id")], 1)
    return same.unionAll(best.select("left_id", "right_id", F.when(F.col("score") >= sure, "similar title").otherwise("similar title, to check").alias("method"), F.round("score", 3).alias("score")))


def match_over_years(left: DataFrame, right: DataFrame) -> DataFrame:
    """match_titles, and for what has no match in its own year the year before, where a title must be more similar (0.68, 0.72 with its position)."""
    own = match_titles(left, right)
    rest = left.join(own.select("left_id"), "left_id", "left_anti")
    before = match_titles(rest, right.withColumn("block", F.col("block") + 1), least=0.68, least_combined=0.72)
    return own.unionAll(before.withColumn("method", F.concat(F.lit("year before: "), "method")))


def resolve_users(names: DataFrame, users: DataFrame) -> DataFrame:
    """names (id, name, department) with user_row and how: name and department, name alone, several, none.

    Of several in the department one with a phone goes first, then the first row.
    """
    u = users.select(F.regexp_replace("name", X.WS, "").alias("key"), F.col("row_number").alias("user_row"), F.col("department").alias("__d"), F.col("display_department").alias("__dd"), F.coalesce(F.col("phone") == "", F.lit(True)).alias("no_phone"))
    j = names.withColumn("key", F.regexp_replace("name", X.WS, "")).join(u, "key", "left")
    j = j.withColumn("own", F.coalesce(X.same_department(F.col("department"), F.col("__d")) | X.same_department(F.col("department"), F.col("__dd")), F.lit(False)))
    g = j.groupBy("id", "name", "department").agg(
        F.count("user_row").alias("n"), F.sum(F.col("own").cast("int")).alias("in_department"),
        F.min(F.when(F.col("own"), F.struct("no_phone", "user_row"))).alias("best"), F.min("user_row").alias("only"))
    how = F.when(F.col("in_department") > 0, "name and department").when(F.col("n") == 1, "name alone").when(F.col("n") > 1, "several").otherwise("none")
    return g.select("id", "name", "department", F.when(F.col("in_department") > 0, F.col("best.user_row")).when(F.col("n") == 1, F.col("only")).alias("user_row"), how.alias("how"))


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays of names hold the same names, blanks aside."""
    key = lambda x: F.array_sort(F.array_distinct(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda v: F.regexp_replace(v, X.WS, ""))))
    return key(a) == key(b)


def compare_sets(a: Column, b: Column) -> Column:
    """missing here, missing there, equal or different."""
    return F.when(F.coalesce(F.size(a), F.lit(0)) <= 0, "missing here").when(F.coalesce(F.size(b), F.lit(0)) <= 0, "missing there").when(same_set(a, b), "equal").otherwise("different")


def covered(a: Column, b: Column) -> Column:
    """Whether all phone numbers of a are among those of b, by their digits."""
    digits = lambda x: F.transform(F.coalesce(x, F.array().cast("array<string>")), X.phone_digits)
    return F.size(F.array_except(digits(a), digits(b))) == 0


def mismatches(tables: DataFrame, owners: DataFrame) -> DataFrame:
    """tables (key, department, officers, phones) that differ from what is expected of them (owners: key, department, officers, phones), with `fields`: department, officers, phones or match.

    A table without an entry has the field match; what an entry doesn't name isn't compared; entries without department
    and officers are none.
    """
    o = owners.select("key", F.col("department").alias("want_department"), F.col("officers").alias("want_officers"), F.col("phones").alias("want_phones"), F.lit(True).alias("__has"))
    j = tables.join(o, "key", "left")
    said = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    named = F.coalesce(F.col("want_department") != "", F.lit(False))
    fields = F.array_compact(F.array(
        F.when(F.col("__has").isNull(), "match"), F.when(named & ~F.coalesce(X.same_department(F.col("want_department"), F.col("department")), F.lit(False)), "department"),
        F.when(said(F.col("want_officers")) & ~same_set(F.col("want_officers"), F.col("officers")), "officers"), F.when(said(F.col("want_phones")) & ~F.coalesce(covered(F.col("want_phones"), F.coalesce("phones", F.array().cast("array<string>"))), F.lit(False)), "phones"),
    ))
    out = j.withColumn("fields", fields).where(F.size("fields") > 0)
    return out.where(F.col("__has").isNull() | named | said(F.col("want_officers"))).drop("__has")


def expected_phones(officers: DataFrame, users: DataFrame) -> DataFrame:
    """key, phones of the officers (key, name, department) as the directory has them; a key none of whose officers has one is left out."""
    r = resolve_users(officers.select(F.col("key").alias("id"), "name", "department"), users).where("user_row is not null")
    p = r.join(users.where("phone <> ''").select(F.col("row_number").alias("user_row"), "phone"), "user_row")
    return p.groupBy(F.col("id").alias("key")).agg(F.array_sort(F.collect_set("phone")).alias("phones"))


def audit(tables: DataFrame, owners: DataFrame, matches: DataFrame, sure: float = 0.7) -> DataFrame:
    """left_id, right_id, method, department, officers, phones, decision: every table (left_id, department, officers, phones) against the entry that match_titles gave it.

    department: equal, different or missing; officers as compare_sets; phones: kept or not. decision: no entry, to check
    (a match below `sure`), equal or differs.
    """
    o = owners.select("right_id", F.col("department").alias("want"), F.col("officers").alias("want_officers"), F.col("phones").alias("want_phones"))
    j = tables.join(matches.select("left_id", "right_id", "method", "score"), "left_id", "left").join(o, "right_id", "left")
    named = F.coalesce(F.col("want") != "", F.lit(False)) & F.coalesce(F.col("department") != "", F.lit(False))
    department = F.when(~named, "missing").when(X.same_department(F.col("want"), F.col("department")), "equal").otherwise("different")
    j = j.select("left_id", "right_id", "method", "score", department.alias("department"), compare_sets(F.col("want_officers"), F.col("officers")).alias("officers"), F.coalesce(covered(F.col("want_phones"), F.col("phones")), F.lit(True)).alias("phones"))
    same = (F.col("department") != "different") & (F.col("officers") != "different") & F.col("phones")
    return j.withColumn("decision", F.when(F.col("right_id").isNull(), "no entry").when(F.col("score") < sure, "to check").when(same, "equal").otherwise("differs")).drop("score")
