"""Rules that need no specs: what a grid's own headers and labels claim, checked by the same plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.functions import text as X
from gridloom.operators import edges, infer
from gridloom.operators.language import spelling
from gridloom.operators.relational import first_n
from gridloom.session import cut

#: Findings of one rule that a table reports at most; with cap=None a rule reports all.
CAP = 30


def from_structure(cells: DataFrame, cap: int | None = CAP) -> DataFrame:
    """Findings of the formula, total (over the columns of one parent), region and ratio-row rules: type, table_id, row_index, col_index, current_value, expected_value."""
    columns, rows = map(cut, infer.structure(cells))
    specs = infer.header_formulas(columns).unionAll(infer.peer_totals(columns)).unionAll(infer.region_totals(columns, rows)).unionAll(infer.ratio_rows(columns, rows))
    specs = cut(specs)
    types = [r["type"] for r in specs.select("type").distinct().collect()]  # a handful
    if not types:
        return cells.limit(0).select(F.lit("").alias("type"), "table_id", "row_index", "col_index", F.lit(0.0).alias("current_value"), F.lit(0.0).alias("expected_value"))
    bad = edges.evaluate(specs, cells, types).where(~F.col("passed"))
    bad = bad.select("type", "table_id", "row_index", "col_index", "current_value", "expected_value")
    return bad if cap is None else first_n(bad, ["type", "table_id"], [F.col("col_index"), F.col("row_index")], cap)


def subtotals(cells: DataFrame, cap: int | None = CAP) -> DataFrame:
    """Subtotal rows against the rows after them in the same group (column 0 carries the group, column 1 the subtotal label).

    Groups are runs of rows with the same group label; a subtotal reaches to the next total of its run.
    """
    lab = cells.where("not is_header and col_index < 2").groupBy("table_id", "row_index").agg(F.max(F.when(F.col("col_index") == 0, X.display(F.col("text_value")))).alias("g"), F.max(F.when(F.col("col_index") == 1, X.display(F.col("text_value")))).alias("l"))
    w = W.partitionBy("table_id").orderBy("row_index")
    run = lab.withColumn("n", F.when((F.lag("g").over(w) == F.col("g")) & ~X.is_subtotal(F.col("l")), 0).otherwise(1)).withColumn("run", F.sum("n").over(w))
    v = cells.where("not is_header and col_index > 1").select("table_id", "row_index", "col_index", N.raw_value(F.col("numeric_value"), F.col("text_value")).alias("v")).where("v is not null")
    j = v.join(run, ["table_id", "row_index"])
    ops = j.where(~X.is_total(F.col("l"))).groupBy("table_id", "run", "col_index").agg(F.sum("v").alias("expected_value"), F.count("*").alias("n_ops")).where("n_ops >= 2")
    t = j.where(X.is_subtotal(F.col("l"))).select("table_id", "run", "row_index", "col_index", F.col("v").alias("current_value"))
    out = t.join(ops, ["table_id", "run", "col_index"]).where(F.abs(F.col("current_value") - F.col("expected_value")) > 1.0)
    out = out.select("table_id", "row_index", "col_index", "current_value", "expected_value")
    return out if cap is None else first_n(out, ["table_id"], [F.col("row_index"), F.col("col_index")], cap)


def change_columns(cells: DataFrame) -> DataFrame:
    """Headers with `(a-b)`: the amount must be a - b, a rate (a - b) / b or / a, whichever is nearer."""
    columns = cut(infer.structure(cells)[0])
    c = columns.join(infer.header_symbols(columns), "table_id").withColumn("h", F.lower(F.regexp_replace("head", X.WS, "")))
    c = c.where(F.col("h").contains("(a-b)")).select("table_id", "col_index", "is_ratio", F.col("symbols")[F.lit("a")].alias("ca"), F.col("symbols")[F.lit("b")].alias("cb")).where("ca is not null and cb is not null")
    v = edges.cell_values(cells.where("not is_header")).select("table_id", "row", "col", "raw").where("raw is not null")
    side = lambda name, col: v.select("table_id", "row", F.col("col").alias(col), F.col("raw").alias(name))
    j = c.join(side("current_value", "col_index"), ["table_id", "col_index"]).join(side("a", "ca"), ["table_id", "ca", "row"]).join(side("b", "cb"), ["table_id", "cb", "row"])
    d = F.col("a") - F.col("b")
    by_b, by_a = F.try_divide(d * 100, "b"), F.try_divide(d * 100, "a")
    near = F.when(by_a.isNotNull() & (F.abs(F.col("current_value") - by_a) < F.abs(F.col("current_value") - by_b)), by_a).otherwise(by_b)
    j = j.withColumn("expected_value", F.when(F.col("is_ratio"), near).otherwise(d)).where("expected_value is not null")
    bad = j.where(F.abs(F.col("current_value") - F.col("expected_value")) > F.when(F.col("is_ratio"), 0.15).otherwise(1.0))
    return bad.select("table_id", F.col("row").alias("row_index"), "col_index", "current_value", "expected_value")


@dataclass(frozen=True)
class Rule:
    """A rule that needs no spec: `find` takes cells and tables and returns table_id, row_index, col_index, current_value, expected_value (texts)."""

    name: str
    severity: str
    find: Callable[[DataFrame, DataFrame], DataFrame]


def _texts(df: DataFrame) -> DataFrame:
    return df.select("table_id", "row_index", "col_index", F.col("current_value").cast("string").alias("current_value"), F.col("expected_value").cast("string").alias("expected_value"))


def missing_metadata(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables without a unit, base date or source, as findings without a place."""
    none = F.lit(None).cast("int")
    return tables.select(F.col("id").alias("table_id"), none.alias("row_index"), none.alias("col_index"), F.lit("").alias("current_value"), F.explode(F.array_compact(F.array(*[F.when(F.trim(F.coalesce(c, F.lit(""))) == "", c) for c in ("unit", "base_date", "source")]))).alias("expected_value"))


#: The rules that are run, by name; an application adds its own with add().
RULES: dict[str, Rule] = {}


def add(rule: Rule) -> Rule:
    RULES[rule.name] = rule
    return rule


add(Rule("metadata", "warning", missing_metadata))
add(Rule("structure", "critical", lambda cells, tables: _texts(from_structure(cells))))
add(Rule("subtotals", "critical", lambda cells, tables: _texts(subtotals(cells))))
add(Rule("changes", "warning", lambda cells, tables: _texts(change_columns(cells))))
add(Rule("spelling", "warning", lambda cells, tables: spelling(cells).select("table_id", "row_index", "col_index", F.col("found").alias("current_value"), F.col("expected").alias("expected_value"))))


def run(cells: DataFrame, tables: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """rule, severity, table_id, row_index, col_index, current_value, expected_value of all rules, or those named."""
    found = [r.find(cells, tables).select(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), "table_id", "row_index", "col_index", "current_value", "expected_value") for r in RULES.values() if only is None or r.name in only]
    return reduce(DataFrame.unionByName, found)
