"""Relational patterns over tables without transactions: latest-wins views, idempotent appends, ranked lookups, nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.session import cut, lookup

#: Letters in a row by which texts that may hold a term are found; shorter terms are looked for whole.
RUN = 4


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, as one hash aggregate with map-side combining (no sort of a key's rows)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *[f"r.{c}" for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key. New must hold a key once."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key old doesn't hold; null keys equal null keys."""
    o, n = old.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct(), new
    on = None
    for k in key:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = c if on is None else on & c
    return n.join(o, on, "left_anti")


def update_where(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def first_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows a group and task before the shuffle."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def closest(left: DataFrame, right: DataFrame, key: list[str], left_pos: str, right_pos: str, right_cols: list[str]) -> DataFrame:
    """Each left row with the right row of the same key whose position is nearest, the smaller position winning a tie.

    Both sides are merged and read once in order, so a key's rows never meet pairwise.
    """
    r = right.select(*key, F.col(right_pos).alias("__p"), F.struct(F.col(right_pos).alias("p"), *right_cols).alias("__r"), F.lit(0).alias("__k"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in key])
    l = left.select(*key, F.col(left_pos).alias("__p"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.lit(1).alias("__k"), *[c for c in left.columns if c not in key])  # noqa: E741
    w = W.partitionBy(*key).orderBy("__p", "__k")
    both = r.unionByName(l).withColumns({"__b": F.last("__r", True).over(w.rowsBetween(W.unboundedPreceding, -1)), "__a": F.first("__r", True).over(w.rowsBetween(1, W.unboundedFollowing))}).where("__k = 1")
    near = F.when(F.col("__a").isNull() | (F.col("__b").isNotNull() & (F.col("__p") - F.col("__b.p") <= F.col("__a.p") - F.col("__p"))), F.col("__b")).otherwise(F.col("__a"))
    return both.withColumn("__n", near).where("__n is not null").select(*left.columns, F.col("__n.p").alias("nearest_pos"), *[F.col(f"__n.{c}") for c in right_cols])


def contains_terms(texts: DataFrame, text: str, terms: DataFrame, term: str, least: int = 2, limit_bytes: int = 8 << 20) -> DataFrame:
    """texts joined to every term that occurs in the text.

    The terms' size is checked: a dictionary within the limit is broadcast and searched by containment; a larger one is
    joined on the term's first `least` characters, which a text holds at bounded places (its distinct character pairs).
    """
    size = terms.agg(F.coalesce(F.sum(F.length(term) * 4 + 32), F.lit(0))).first()[0]
    t = terms.where(F.length(term) >= least)
    if size <= limit_bytes:
        return texts.join(F.broadcast(t), F.col(text).contains(F.col(term)))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - least + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(least))))
    x = texts.withColumn("__g", F.explode(grams))
    return x.join(t.withColumn("__g", F.substring(term, 1, least)), "__g").where(F.col(text).contains(F.col(term))).drop("__g")


def _runs(text: str, n: int) -> Column:
    """Every n letters in a row of a text, overlapping, in one pass over it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def first_holding(terms: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """on, k, n, at: for each of terms (on, k) the least `at` of the texts (on, t, at) of the same key that equal it (n is 0), else of those that hold it (n is 1). Terms that no text holds are left out.

    Equal texts are found by key, among those no shorter than the key's shortest term. Terms without one only meet longer texts
    that hold the rarest of their runs of letters, so that the terms and texts of one key, of which there may be millions, never
    meet pairwise.
    """
    shortest = cut(terms.groupBy(*on).agg(F.min(F.length("k")).alias("__least")))
    texts = lookup(texts, shortest, on, "t").where(F.length("t") >= F.col("__least"))
    each = texts.groupBy(*on, F.col("t").alias("k")).agg(F.min("at").alias("at"))
    found = cut(terms.select(*on, "k").distinct().join(each, [*on, "k"], "left"))
    equal = found.where("at is not null").select(*on, "k", F.lit(0).alias("n"), "at")
    left = found.where("at is null").drop("at")
    if left.isEmpty():
        return equal
    keys = cut(left.groupBy(*on).agg(F.min(F.length("k")).alias("__least"), F.collect_set(F.least(F.length("k"), F.lit(RUN))).alias("__sizes")))
    longer = cut(lookup(texts.drop("__least"), keys, on, "t").where(F.length("t") > F.col("__least")).groupBy(*on, "t", "__sizes").agg(F.min("at").alias("at")))
    runs = F.array_distinct(F.concat(*[F.when(F.array_contains("__sizes", n), _runs("t", n)).otherwise(F.array().cast("array<string>")) for n in range(1, RUN + 1)]))
    counts = longer.select(*on, F.explode(runs).alias("__run")).groupBy(*on, "__run").agg(F.count("*").alias("__texts"))
    own = left.select(*on, "k", F.explode(F.when(F.length("k") < RUN, F.array("k")).otherwise(F.array_distinct(_runs("k", RUN)))).alias("__run"))
    rarest = own.join(counts, [*on, "__run"], "left").groupBy(*on, "k").agg(F.min(F.struct(F.coalesce("__texts", F.lit(0)).alias("texts"), "__run")).alias("__r"))
    sought = cut(rarest.where("__r.texts > 0").select(*on, "k", "__r.__run"))  # a run that no text has: nor has any text the term
    held = longer.select(*on, "t", "at", F.explode(runs).alias("__run")).join(sought, [*on, "__run"]).where(F.col("t").contains(F.col("k")))
    return equal.unionByName(held.groupBy(*on, "k").agg(F.min("at").alias("at")).withColumn("n", F.lit(1)))
