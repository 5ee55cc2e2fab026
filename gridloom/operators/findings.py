"""What checks amount to: issues, their de-duplication, roll-ups, summaries, orderings, runs and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import labels as L
from gridloom.functions import numeric as N
from gridloom.operators.edges import NORMAL, REVIEW, SUSPECT


def summary(checks: DataFrame) -> DataFrame:
    """checks, normal, suspect, tables: one row for a run."""
    return checks.agg(F.count("*").alias("checks"), F.count_if(F.col("status") == NORMAL).alias("normal"), F.count_if(F.col("status") == SUSPECT).alias("suspect"), F.count_distinct("table_id").alias("tables"))


def rollup(checks: DataFrame) -> DataFrame:
    """table_id, status (critical beats any other finding beats normal), issues."""
    rank = F.max(F.when(F.col("passed"), 0).when(F.col("severity") == "critical", 2).otherwise(1))
    return checks.groupBy("table_id").agg(rank.alias("rank"), F.count_if(~F.col("passed")).alias("issues")).select("table_id", F.when(F.col("rank") == 2, SUSPECT).when(F.col("rank") == 1, REVIEW).otherwise(NORMAL).alias("status"), "issues")


def group_rollup(checks: DataFrame, groups: DataFrame) -> DataFrame:
    """group, status, issues, counts (type -> issues) of groups of tables (table_id, group)."""
    x = checks.join(groups, "table_id")
    rank = F.max(F.when(F.col("passed"), 0).when(F.col("severity") == "critical", 2).otherwise(1))
    by = x.groupBy("group", "type").agg(rank.alias("rank"), F.count_if(~F.col("passed")).alias("n"))
    out = by.groupBy("group").agg(F.max("rank").alias("rank"), F.sum("n").alias("issues"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("type", "n"))))).alias("counts"))
    return out.select("group", F.when(F.col("rank") == 2, SUSPECT).when(F.col("rank") == 1, REVIEW).otherwise(NORMAL).alias("status"), "issues", "counts")


def issue_counts(checks: DataFrame) -> DataFrame:
    return checks.where(~F.col("passed")).groupBy("type").agg(F.count("*").alias("issues"))


def issues(checks: DataFrame) -> DataFrame:
    """Failing checks; a suspected error is always critical."""
    return checks.where(~F.col("passed")).withColumn("severity", F.when(F.col("status") == SUSPECT, "critical").otherwise(F.col("severity")))


def dedupe_issues(checks: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Failing checks, the first of each key; the rule isn't part of the key."""
    return checks.where(~F.col("passed")).withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("n = 1").drop("n")


def visible(checks: DataFrame, tables: DataFrame, hidden: tuple[str, ...] = ("outlier_columns",)) -> DataFrame:
    """table_id, status, issues of every table (table_id) from the checks that aren't hidden; one without any is normal."""
    seen = rollup(checks.where(~F.col("type").isin(*hidden)))
    return tables.select("table_id").distinct().join(seen, "table_id", "left").select("table_id", F.coalesce("status", F.lit(NORMAL)).alias("status"), F.coalesce("issues", F.lit(0)).alias("issues"))


def merged_highlights(highlights: DataFrame, group: str) -> DataFrame:
    """table_id, row, col, role of all checks of a group; target beats related."""
    x = highlights.select("table_id", group, F.explode("cells").alias("h"))
    return x.groupBy("table_id", group, F.col("h.row").alias("row"), F.col("h.col").alias("col")).agg(F.max(F.col("h.role")).alias("role"))


def save_run(checks: DataFrame, path: str, run_id: str) -> None:
    """Appends the checks and issues of a run, partitioned by run; the partition of a repeated run is replaced, never doubled."""
    checks.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/checks")
    issues(checks).withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/issues")


def medians(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, median, n: exact medians by counts of distinct values and a sorted running count, which spills; no group is held in memory."""
    f = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    whole = W.partitionBy(*group)
    f = f.withColumns({"__to": F.sum("__n").over(whole.orderBy("__v").rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("__n").over(whole)})
    covers = lambda k: (F.col("__to") >= k) & (F.col("__to") - F.col("__n") < k)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return f.groupBy(*group).agg(((F.max(F.when(covers(low), F.col("__v"))) + F.max(F.when(covers(high), F.col("__v")))) / 2).alias("median"), F.first("n").alias("n"))


def outliers(values: DataFrame, group: list[str], value: str, order: list[str], multiplier: float = 8.0, most: int = 5, least: int = 5, top_of: list[str] | None = None) -> DataFrame:
    """Rows whose |x - median| / MAD exceeds the multiplier, the `most` highest of each `top_of` (by score, then `order`, descending).

    Groups with fewer than `least` values or a MAD of 0 have none. Medians are exact.
    """
    x = values.where(F.col(value).isNotNull())
    x = x.join(medians(x, group, value).where(F.col("n") >= least), group).withColumn("dev", F.abs(F.col(value) - F.col("median")))
    mad = medians(x, group, "dev").select(*group, F.col("median").alias("mad")).where("mad <> 0")
    x = x.join(mad, group).withColumn("score", F.col("dev") / F.col("mad")).where(F.col("score") > multiplier)
    w = W.partitionBy(*(top_of or group)).orderBy(F.desc("score"), *[F.desc(c) for c in order])
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def outlier_checks(cells: DataFrame, multiplier: float = 20.0, most: int = 5) -> DataFrame:
    """table_id, row_index, col_index, score, passed: the outliers of each grid, totals' rows left aside; a grid with numbers but no outlier passes, without a place."""
    kinds = cells.where("not is_header and col_index = 0").select("table_id", "row_index", L.total_kind(F.col("text_value")).alias("kind")).where("kind is not null")
    data = cells.where("not is_header and col_index > 0").join(kinds, ["table_id", "row_index"], "left_anti")
    v = data.select("table_id", "row_index", "col_index", N.raw_value(F.col("numeric_value"), F.col("text_value")).alias("x")).where("x is not null")
    found = outliers(v, ["table_id", "col_index"], "x", ["row_index", "col_index"], multiplier, most, 5, ["table_id"]).select("table_id", "row_index", "col_index", "score")
    none = v.select("table_id").distinct().join(found.select("table_id"), "table_id", "left_anti")
    return found.withColumn("passed", F.lit(False)).unionByName(none.withColumn("passed", F.lit(True)), allowMissingColumns=True)
