"""Inference of check specs: candidates from headers and labels, scored by the very plan that runs the checks.

Every generator turns the structure of all grids into candidate specs; one evaluation of all candidates gives each its
pass ratio, and those with enough evidence stay, the best of those that explain the same target first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import labels as L
from gridloom.functions import numeric as N
from gridloom.functions import text as X
from gridloom.operators import edges, grids
from gridloom.session import cut

MALE, FEMALE = "^(남|남성|남자|male)", "^(여|여성|여자|female)"


def spec_rows(df: DataFrame, kind: str, group: str, **fields) -> DataFrame:
    """df (one row per spec, with table_id) as SPEC rows."""
    given = {"table_id": F.col("table_id"), "type": F.lit(kind), "check_group": F.lit(group), "severity": F.lit("warning")} | {k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()}
    cols = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in edges.SPEC.fields]
    out = df.select(*cols)
    key = F.concat_ws(":", "type", "table_id", *[F.to_json(F.struct(c)) for c in ("target_row", "target_column", "operand_columns", "operand_rows", "columns", "terms", "numerator_column", "denominator_columns", "denominator_row", "numerator_row", "denominator_rows", "multiplier", "current_column", "previous_column", "row_pairs", "row_indices", "operand_cells")])
    return out.withColumn("spec_id", F.concat_ws(":", "type", "table_id", F.hex(F.xxhash64(key))))


def structure(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, rows): the numeric columns with their header texts and kinds; the data rows with their labels and kinds."""
    labels = grids.label_columns(cells)
    heads = grids.header_stacks(cells).select("table_id", "col_index", grids.column_text(F.col("stack"), F.col("col_index")).alias("head"), F.coalesce(grids.leaf(F.col("stack")), F.lit("")).alias("leaf"), grids.parent_key(F.col("stack")).alias("parent"))
    shown = F.regexp_replace(X.display(F.col("text_value")), "[,%]", "")
    places = F.when(shown.rlike(r"^[-+]?[0-9]+$"), 0).when(shown.rlike(r"^[-+]?[0-9]+[.][0-9]+$"), F.length(F.regexp_extract(shown, r"[.]([0-9]+)$", 1)))
    numbers = cells.where("not is_header").groupBy("table_id", "col_index").agg(F.count(N.raw_value(F.col("numeric_value"), F.col("text_value"))).alias("numbers"), F.max(places).alias("decimals"))
    heads = heads.join(grids.header_paths(cells), ["table_id", "col_index"], "left")
    key = X.normalize(F.col("leaf"))
    each = F.transform("parts", L.total_kind)
    kind = F.when(F.array_contains(each, "subtotal"), "subtotal").when(F.array_contains(each, "total"), "total")
    columns = heads.join(numbers, ["table_id", "col_index"]).join(labels, "table_id").where(~F.array_contains("label_columns", F.col("col_index"))).select(
        "table_id", "col_index", "head", "leaf", "parent", "numbers", "decimals", "path", "total_at",
        (key.isin("계", "합계", "총계", "소계", "total", "subtotal") | X.normalize(F.col("head")).rlike("(계|합계)total$")).alias("is_total"),
        X.is_ratio(F.col("head")).alias("is_ratio"), X.is_additive(F.col("head")).alias("additive"), key.rlike(MALE).alias("male"), key.rlike(FEMALE).alias("female"), X.year_of(F.col("leaf")).alias("year"),
    )
    l = grids.combined_labels(cells).join(grids.row_parts(cells), ["table_id", "row_index"], "left")  # noqa: E741
    rows = l.select("table_id", "row_index", "label", F.col("leaf").alias("leaf_label"), "depth", F.col("parts")[0].alias("first"), kind.alias("kind"), (L.is_per_unit(F.col("label"))).alias("per_unit"), L.is_average(F.col("label")).alias("average"), X.is_total(F.col("label")).alias("is_total"), X.is_ratio(F.col("label")).alias("is_ratio"), X.normalize(F.col("label")).rlike("증감률|증가율|성장률|growthrate").alias("is_growth"), X.year_of(F.col("label")).alias("year"), F.substring(X.display(F.col("label")), 1, 2).isin(*[k for k in X.REGIONS if len(k) == 2]).alias("region"))
    return columns, rows


def header_symbols(columns: DataFrame) -> DataFrame:
    """table_id, symbols: map from `(x)` and `(x=..)` in header texts to the first column that has it."""
    s = columns.select("table_id", "col_index", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("head"), F.lit(r"\(([a-z])(?:\)|\s*=)"), F.lit(1)))).alias("symbol"))
    s = s.groupBy("table_id", "symbol").agg(F.min("col_index").alias("c"))
    return s.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "c"))).alias("symbols"))


def header_formulas(columns: DataFrame) -> DataFrame:
    """`(c=a+b)` becomes row_arithmetic; `(a/b)`, `(a/b*100)` and `a/(b+c)` row_ratio; `(a)`, `(b)` with `(a-b)/b` row_growth_rate."""
    c = columns.join(header_symbols(columns), "table_id").withColumn("h", F.lower(F.regexp_replace("head", X.WS, "")))
    sums = c.withColumn("f", F.explode(F.regexp_extract_all("h", F.lit(r"\(([a-z]=[a-z](?:[+-][a-z])+)\)"), F.lit(1)))).withColumn("target", F.col("symbols")[F.substring("f", 1, 1)])
    terms = F.transform(F.regexp_extract_all(F.concat(F.lit("+"), F.substring("f", 3, 100)), F.lit(r"[+-][a-z]"), F.lit(0)), lambda t: F.struct(F.substring(t, 1, 1).alias("op"), F.col("symbols")[F.substring(t, 2, 1)].alias("column")))
    sums = sums.withColumn("terms", terms).where(~F.exists("terms", lambda t: t["column"].isNull()) & F.col("target").isNotNull())
    ratio = r"\(([a-z])/([a-z])(?:[*x×]100)?\)"
    r = c.where(F.col("h").rlike(ratio)).withColumns({"n": F.col("symbols")[F.regexp_extract("h", ratio, 1)], "d": F.col("symbols")[F.regexp_extract("h", ratio, 2)]}).where("n is not null and d is not null")
    several = r"([a-z])/\(([a-z](?:\+[a-z])+)\)"
    m = c.where(F.col("h").rlike(several)).withColumns({"n": F.col("symbols")[F.regexp_extract("h", several, 1)], "d": F.transform(F.split(F.regexp_extract("h", several, 2), r"\+"), lambda x: F.col("symbols")[x])}).where(F.col("n").isNotNull() & F.forall("d", lambda x: x.isNotNull()))
    g = c.where(F.col("h").rlike(r"\(a-b\)/b|증감률|증가율|growthrate") & ~F.col("h").rlike(r"\([ab]\)")).withColumns({"cur": F.col("symbols")[F.lit("a")], "prev": F.col("symbols")[F.lit("b")]}).where("cur is not null and prev is not null")
    return reduce(DataFrame.unionAll, [
        spec_rows(sums, "row_arithmetic", "sum", target_column=F.col("target"), terms=F.col("terms"), confidence=0.98),
        spec_rows(r, "row_ratio", "ratio", target_column=F.col("col_index"), numerator_column=F.col("n"), denominator_columns=F.array("d"), multiplier=F.when(F.col("h").contains("100)") | F.col("is_ratio"), 100.0).otherwise(1.0), tolerance=0.15, confidence=0.98),
        spec_rows(m, "row_ratio", "ratio", target_column=F.col("col_index"), numerator_column=F.col("n"), denominator_columns=F.col("d"), multiplier=100.0, tolerance=0.15, confidence=0.98),
        spec_rows(g, "row_growth_rate", "growth_rate", target_column=F.col("col_index"), current_column=F.col("cur"), previous_column=F.col("prev"), tolerance=0.15, confidence=0.98),
    ])


#: Widest grids whose subsets of columns are tried, and the largest subsets.
WIDEST, LARGEST = 10, 7


def value_columns(columns: DataFrame) -> DataFrame:
    return columns.where("additive and not is_ratio and numbers > 0")


def operand_columns(columns: DataFrame, runs: bool = True) -> DataFrame:
    """table_id, col_index, operands: what the headers say that a total column is made of.

    The columns under it (one level more of its path); those that differ from it in the level of the total alone; the
    totals of the same name under other parents; if its total stands at the top, the totals of every other group or
    the group's columns; the other columns under the same parent; male and female; runs of neighbouring columns.
    """
    v = value_columns(columns)
    t = v.where("is_total or total_at is not null").select("table_id", F.col("col_index").alias("t"), F.col("path").alias("tp"), F.col("total_at").alias("ta"), F.col("leaf").alias("tl"), F.col("parent").alias("tparent"))
    o = v.withColumn("sums", F.col("is_total") | F.col("total_at").isNotNull())
    j = t.join(o, "table_id").where("col_index <> t")
    key = lambda p: F.transform(p, lambda x: X.normalize(x))
    j = j.withColumns({"k": key(F.col("path")), "tk": key(F.col("tp"))})
    leaf_total = L.total_kind(F.col("leaf")).isNotNull()
    nested = ~leaf_total & (F.size("k") == F.size("tk") + 1) & (F.slice("k", 1, F.greatest(F.size("tk"), F.lit(1))) == F.col("tk"))
    replaced = ~leaf_total & (F.size("k") == F.size("tk")) & F.forall(F.transform("k", lambda x, i: (i == F.col("ta")) | (x == F.get("tk", i))), lambda x: x)
    sibling = leaf_total & (X.normalize(F.col("leaf")) == X.normalize(F.col("tl"))) & (F.col("parent") != F.col("tparent"))
    peer = ~F.col("is_total") & (F.col("parent") == F.col("tparent"))
    flat = (F.size("tk") == 1) & ~F.col("sums")
    out = [j.where(c).groupBy("table_id", "t").agg(F.array_sort(F.collect_list("col_index")).alias("ops")) for c in (nested, replaced, sibling, peer, flat)]
    # Groups beside a total at the top: a group's own total stands for it, else its columns.
    root = j.where("ta = 0").withColumn("root", F.col("k")[0]).where(L.total_kind(F.col("path")[0]).isNull())
    group = root.groupBy("table_id", "t", "root").agg(F.collect_list(F.when(F.col("sums"), F.col("col_index"))).alias("totals"), F.collect_list("col_index").alias("all"))
    out.append(group.groupBy("table_id", "t").agg(F.array_sort(F.flatten(F.collect_list(F.when(F.size("totals") > 0, F.col("totals")).otherwise(F.col("all"))))).alias("ops")))
    sexes = j.where("(male or female) and parent = tparent").groupBy("table_id", "t").agg(F.array_sort(F.collect_list("col_index")).alias("ops"), F.sum(F.col("male").cast("int")).alias("m")).where("size(ops) = 2 and m = 1").drop("m")
    out.append(sexes)
    every = j.where("true" if runs else "false").groupBy("table_id", "t").agg(F.array_sort(F.collect_list("col_index")).alias("c"))
    some = every.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("c")))).withColumn("n", F.explode(F.expr("case when size(c) - i >= 1 then sequence(2, size(c) - i + 1) end")))
    some = some.select("table_id", "t", F.expr("slice(c, i, n)").alias("ops")).where("t < ops[0] or t > element_at(ops, -1) or abs(t - element_at(ops, -1)) <= 3")
    out.append(some)
    return reduce(DataFrame.unionByName, out).where("size(ops) >= 2").distinct().withColumnsRenamed({"t": "col_index", "ops": "operands"})


def peer_totals(columns: DataFrame) -> DataFrame:
    """A total column from the other additive columns under the same parent header, and from male and female under it."""
    o = operand_columns(columns, runs=False)
    one = columns.select("table_id", "col_index", F.col("parent").alias("own"), "is_total").where("is_total").drop("is_total")
    kinds = columns.groupBy("table_id", "parent").agg(F.array_sort(F.collect_list(F.when(F.col("additive") & ~F.col("is_total") & ~F.col("is_ratio") & (F.col("numbers") > 0), F.col("col_index")))).alias("peers"), F.array_sort(F.collect_list(F.when((F.col("male") | F.col("female")) & F.col("additive") & (F.col("numbers") > 0), F.col("col_index")))).alias("sexes"))
    o = o.join(one, ["table_id", "col_index"]).join(kinds.withColumnRenamed("parent", "own"), ["table_id", "own"]).where("operands = peers or operands = sexes")
    return spec_rows(o, "row_sum", "sum", target_column=F.col("col_index"), operand_columns=F.col("operands"), tolerance=1.0)


def total_columns(columns: DataFrame) -> DataFrame:
    """A total column from each set of columns that its header allows."""
    return spec_rows(operand_columns(columns), "row_sum", "sum", target_column=F.col("col_index"), operand_columns=F.col("operands"), tolerance=1.0)


def column_combinations(columns: DataFrame, cells: DataFrame) -> DataFrame:
    """Total columns from the sets of 2 to LARGEST columns that add up, in grids of up to WIDEST other value columns.

    All sets of a row are tried at once, as subset sums in numpy; a task adds up how often each set held in its rows of
    a grid, and those counts, never rows, meet. A set stays if it held in 0.6 of three rows or more, 0.8 of two.
    """
    v = value_columns(columns)
    targets = v.where("is_total or total_at is not null").select("table_id", F.col("col_index").alias("t"))
    sets = v.groupBy("table_id").agg(F.array_sort(F.collect_list("col_index")).alias("cols")).where((F.size("cols") > 2) & (F.size("cols") <= WIDEST + 1))
    plan = targets.join(sets, "table_id").select("table_id", "t", F.array_remove("cols", F.col("t")).alias("cols"))
    x = edges.cell_values(cells.where("not is_header").join(plan.select("table_id").distinct(), "table_id", "left_semi")).where("operand is not null").select("table_id", "row", F.struct("col", "operand", "target").alias("c"))
    rows = x.groupBy("table_id", "row").agg(F.collect_list("c").alias("c")).join(plan, "table_id")  # as wide as a grid
    value = lambda k, f: F.element_at(F.transform(F.filter("c", lambda e: e["col"] == k), lambda e: e[f]), 1)
    rows = rows.where(F.exists("c", lambda e: (e["col"] == F.col("t")) & e["target"].isNotNull())).select("table_id", "t", "cols", value(F.col("t"), "target").alias("now"), F.transform("cols", lambda k: F.coalesce(F.try_element_at(F.transform(F.filter("c", lambda e: e["col"] == k), lambda e: e["operand"]), F.lit(1)), F.lit(float("nan")))).alias("v"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, tuple[int, ...]], np.ndarray] = {}
        for b in batches:
            grids_: dict[tuple[int, int, tuple[int, ...]], list[int]] = {}
            for i, k in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(tuple, b.column(2).to_pylist()))):
                grids_.setdefault(k, []).append(i)
            now, values = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_pylist()
            for k, at in grids_.items():
                bits = subset_bits(len(k[2])).T
                v = np.array([values[i] for i in at])
                whole = np.isnan(v).astype(float) @ bits == 0
                ok = whole & (np.abs(np.nan_to_num(v) @ bits - now[at][:, None]) <= 1.0)
                held[k] = held.get(k, 0) + np.array([whole.sum(axis=0), ok.sum(axis=0)])
        if held:
            masks = [(subset_bits(len(k[2])) @ (1 << np.arange(len(k[2])))).astype(int).tolist() for k in held]
            lists = lambda i: pa.array([x[i].tolist() for x in held.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int32()), pa.array([list(k[2]) for k in held], pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int32())), lists(0), lists(1)], names=["table_id", "t", "cols", "mask", "checked", "held"])

    counts = rows.mapInArrow(kernel, "table_id long, t int, cols array<int>, mask array<int>, checked array<long>, held array<long>")
    each = counts.select("table_id", "t", "cols", F.explode(F.arrays_zip("mask", "checked", "held")).alias("n")).groupBy("table_id", "t", "cols", "n.mask").agg(F.sum("n.checked").alias("checked"), F.sum("n.held").alias("held"))
    good = each.where((F.col("held") >= F.when(F.col("checked") >= 3, 0.6).otherwise(0.8) * F.col("checked")) & (F.col("checked") >= 2))
    good = good.withColumn("ops", F.expr("filter(cols, (x, i) -> (shiftright(mask, i) & 1) = 1)"))
    return spec_rows(good, "row_sum", "sum", target_column=F.col("t"), operand_columns=F.col("ops"), tolerance=1.0)


@lru_cache(maxsize=32)
def subset_bits(n: int) -> np.ndarray:
    """The sets of 2 to LARGEST of n things as rows of 0 and 1, in order of their number in binary."""
    bits = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    size = bits.sum(axis=1)
    return bits[(size >= 2) & (size <= LARGEST)].astype(float)


def operand_rows(rows: DataFrame) -> DataFrame:
    """table_id, row_index, operands: what the labels say that a total row is made of.

    The rows after it up to the next total; the subtotals after it; all details after it up to the next total of its
    kind; of those the ones with its own last label, and those of each group (first label); if it stands in the second
    half, the run of details before it; and all details of the grid. A row whose labels begin further left than those
    after it, up to the next such row, is the total of these.
    """
    has = rows.where("kind is not null").select("table_id").distinct()
    deep = rows.groupBy("table_id").agg(F.max("depth").alias("d")).where("d > 0").select("table_id")
    w = W.partitionBy("table_id").orderBy("row_index")
    detail = F.col("kind").isNull() & ~F.col("is_ratio") & ~F.col("is_growth") & ~F.col("per_unit") & ~F.col("average")
    r = rows.join(has, "table_id", "left_semi").withColumns({
        "run": F.sum(F.col("kind").isNotNull().cast("int")).over(w), "span": F.sum((F.col("kind") == "total").cast("int")).over(w), "place": F.row_number().over(w),
        "of": F.count("*").over(W.partitionBy("table_id")), "detail": detail,
    })
    r = r.withColumn("span", F.coalesce("span", F.lit(0)))
    listed = lambda df, *by: df.groupBy("table_id", *by).agg(F.array_sort(F.collect_list("row_index")).alias("operands"))
    t = r.where("kind is not null").select("table_id", "row_index", "run", "span", "kind", "place", "of", X.normalize(F.col("leaf_label")).alias("leaf"))
    d = r.where("detail")
    out = [
        t.join(listed(d, "run"), ["table_id", "run"]), t.join(listed(d.select("table_id", "row_index", (F.col("run") + 1).alias("run")), "run"), ["table_id", "run"]).where("kind = 'total' and place * 2 >= of"),
        t.where("kind = 'total'").join(listed(r.where("kind = 'subtotal'"), "span"), ["table_id", "span"]), t.where("kind = 'total'").join(listed(d, "span"), ["table_id", "span"]),
        t.where("kind = 'total'").join(listed(d.withColumn("leaf", X.normalize(F.col("leaf_label"))), "span", "leaf"), ["table_id", "span", "leaf"]),
        t.where("kind = 'total'").join(listed(d, "span", "first").drop("first"), ["table_id", "span"]), t.join(listed(d), "table_id"),
    ]
    nested = rows.join(deep, "table_id", "left_semi").withColumn("detail", detail)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    for level in (0, 1):
        up = F.last(F.when(F.col("depth") <= level, F.struct("row_index", "depth", "kind")), ignorenulls=True).over(before)
        kids = nested.withColumn("up", up).where((F.col("depth") > level) & (F.col("up.depth") == level) & F.col("detail") & F.col("up.kind").isNull())
        out.append(kids.groupBy("table_id", F.col("up.row_index").alias("parent")).agg(F.array_sort(F.collect_list("row_index")).alias("operands")).withColumnRenamed("parent", "row_index"))
    return reduce(DataFrame.unionByName, [x.select("table_id", "row_index", "operands") for x in out]).where("size(operands) >= 2").distinct()


# Words of labels that are totals without saying so; their sums may be off by what rounding does.
SUMS = "전체|전국|규모|수입|자산|예산|운행대수|지방자치단체|일반직|특별회계|일반회계|조세|소속기관|total|aggregate|scale|revenue|assets|budget"
#: Rows after a row that may add up to it, and the share of its columns in which they must.
PREFIX, PREFIX_SHARE = 30, 0.95


def implicit_subtotals(columns: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows that no label calls totals, with the fewest of the next PREFIX details that add up to them in nearly all columns, two at least.

    The running sums of the next rows are windows of bounded length, so a grid of any size is never held as a whole.
    Rows whose label is a number or a date are none, nor are regions before regions.
    """
    w = W.partitionBy("table_id").orderBy("row_index")
    detail = F.col("kind").isNull() & ~F.col("is_ratio") & ~F.col("is_growth") & ~F.col("per_unit") & ~F.col("average")
    r = rows.withColumn("run", F.sum(F.col("kind").isNotNull().cast("int")).over(w)).where(detail)
    r = r.select("table_id", "row_index", "run", "region", F.when(X.normalize(F.col("label")).rlike(SUMS), 1.0).otherwise(0.01).alias("most"), (X.normalize(F.col("first")).rlike(r"^\d{1,4}$") | F.col("first").rlike(r"^[’']?\d{2,4}[./-]\d")).alias("ordered"))
    v = edges.cell_values(cells.where("not is_header")).select("table_id", F.col("row").alias("row_index"), F.col("col").alias("col_index"), "target", "operand")
    v = v.join(value_columns(columns).select("table_id", "col_index"), ["table_id", "col_index"]).join(r, ["table_id", "row_index"])
    ahead = W.partitionBy("table_id", "col_index", "run").orderBy("row_index").rowsBetween(1, PREFIX)
    x = v.withColumns({"next": F.collect_list(F.coalesce("operand", F.lit(float("nan")))).over(ahead), "rows": F.collect_list("row_index").over(ahead), "regions": F.collect_list("region").over(ahead)})
    x = x.where("not ordered and target is not null and size(next) >= 2")
    sums = F.expr("aggregate(next, cast(array() as array<double>), (a, e) -> concat(a, array(coalesce(try_element_at(a, -1), 0.0) + e)))")
    x = x.withColumn("hits", F.filter(F.transform(sums, lambda s, i: F.when(F.abs(s - F.col("target")) <= F.col("most"), i + 1)), lambda i: i >= 2))
    checked = x.groupBy("table_id", "row_index").agg(F.count("*").alias("checked"))
    hit = x.select("table_id", "row_index", "col_index", "region", "rows", "regions", F.explode("hits").alias("n")).groupBy("table_id", "row_index", "n").agg(F.count("*").alias("held"), F.first("rows").alias("rows"), F.first("region").alias("region"), F.first("regions").alias("regions"))
    hit = hit.join(checked, ["table_id", "row_index"]).where((F.col("held") >= 2) & (F.col("held") >= PREFIX_SHARE * F.col("checked")))
    hit = hit.where(~(F.col("region") & F.forall(F.slice("regions", 1, F.col("n")), lambda x: x)))
    first = hit.groupBy("table_id", "row_index").agg(F.min(F.struct("n", "rows")).alias("b")).select("table_id", "row_index", F.slice("b.rows", F.lit(1), F.col("b.n")).alias("operands"))
    cols = value_columns(columns).groupBy("table_id").agg(F.array_sort(F.collect_list("col_index")).alias("cols"))
    return spec_rows(first.join(cols, "table_id"), "column_sum", "sum", target_row=F.col("row_index"), columns=F.col("cols"), operand_rows=F.col("operands"), tolerance=1.0)


def total_rows(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """A total row from each set of rows that its label allows."""
    cols = value_columns(columns).groupBy("table_id").agg(F.array_sort(F.collect_list("col_index")).alias("cols"))
    return spec_rows(operand_rows(rows).join(cols, "table_id"), "column_sum", "sum", target_row=F.col("row_index"), columns=F.col("cols"), operand_rows=F.col("operands"), tolerance=1.0)


def wrapped_totals(columns: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """A total among the first five rows with one value in a grid of several value columns: the sum of all detail cells, four at least in two columns."""
    v = edges.cell_values(cells.where("not is_header")).select("table_id", F.col("row").alias("row_index"), F.col("col").alias("col_index"), "target", "operand").join(value_columns(columns).select("table_id", "col_index"), ["table_id", "col_index"])
    place = F.row_number().over(W.partitionBy("table_id").orderBy("row_index"))
    tops = rows.withColumn("place", place).where("place <= 5 and kind = 'total'").select("table_id", "row_index")
    one = v.where("target is not null").join(tops, ["table_id", "row_index"]).groupBy("table_id", "row_index").agg(F.count("*").alias("n"), F.min("col_index").alias("col_index")).where("n = 1")
    one = one.groupBy("table_id").agg(F.min(F.struct("row_index", "col_index")).alias("t")).select("table_id", "t.*")
    parts = v.where("operand is not null").join(rows.where("kind is null").select("table_id", "row_index"), ["table_id", "row_index"]).join(one.select("table_id", F.col("row_index").alias("t")), "table_id").where("row_index <> t")
    parts = parts.groupBy("table_id").agg(F.count("*").alias("n"), F.count_distinct("col_index").alias("k"), F.array_sort(F.collect_list(F.struct(F.col("row_index").alias("row"), F.col("col_index").alias("column"), F.lit("+").alias("op")))).alias("operands")).where("n >= 4 and k >= 2")
    return spec_rows(one.join(parts, "table_id"), "cell_sum", "sum", target_row=F.col("row_index"), target_column=F.col("col_index"), operand_cells=F.col("operands"), tolerance=1.0, confidence=0.95)


def region_totals(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """The first total among the first five rows from at least 8 region rows."""
    cols = columns.where("additive and not is_ratio").groupBy("table_id").agg(F.array_sort(F.collect_list("col_index")).alias("cols"))
    regions = rows.where("region").groupBy("table_id").agg(F.array_sort(F.collect_list("row_index")).alias("ops")).where("size(ops) >= 8")
    n = F.row_number().over(W.partitionBy("table_id").orderBy("row_index"))
    total = rows.withColumn("n", n).where("n <= 5 and is_total").groupBy("table_id").agg(F.min("row_index").alias("row_index"))
    return spec_rows(total.join(regions, "table_id").join(cols, "table_id"), "region_total", "sum", target_row=F.col("row_index"), columns=F.col("cols"), operand_rows=F.col("ops"), tolerance=1.0)


#: Words of a base, and of what a ratio's name and its numerator share.
BASES = "대상|기준|전체|인구|신고|접수|base|target|population|total"
USES, TAKES = "이용|사용|활용|usage|use", "참여|가입|채택|확보|비축|수용|adoption|insured|secured|reserve"


def ratio_score(target: Column, numerator: Column, denominator: Column, near: Column, before: Column, of_total: Column) -> Column:
    """How well the headers of a ratio column and of two others fit: the numerator right before it, a total or a base as denominator, words in common."""
    t, n, d = X.normalize(target), X.normalize(numerator), X.normalize(denominator)
    points = ((near, 4), (before, 1), (of_total | d.rlike("계|합계|총계|total"), 5), (d.rlike(BASES), 2), (d.rlike("gdp|총|전체|계"), 2), (t.rlike(USES) & n.rlike(USES), 3), (t.rlike(TAKES) & n.rlike(TAKES), 3), (n == d, -4))
    return reduce(lambda a, b: a + b, (F.when(c, k).otherwise(0) for c, k in points))


def same_row_ratios(columns: DataFrame) -> DataFrame:
    """A ratio column from every ordered pair of value columns of its grid, whatever its width, times 100 or 1; its own decimals set the tolerance."""
    v = columns.where("not is_ratio and numbers > 0")
    side = lambda p: v.select("table_id", F.col("col_index").alias(p), F.col("head").alias(f"{p}_head"), F.col("is_total").alias(f"{p}_total"))
    c = columns.where("is_ratio").join(side("n"), "table_id").join(side("d"), "table_id").where("n <> d").withColumn("m", F.explode(F.array(F.lit(100.0), F.lit(1.0))))
    score = ratio_score(F.col("head"), F.col("n_head"), F.col("d_head"), F.col("n") == F.col("col_index") - 1, F.col("d") < F.col("n"), F.col("d_total"))
    tolerance = F.when(F.col("m") != 100, 0.001).when(F.col("decimals") == 0, 0.5).otherwise(0.15)
    return spec_rows(c, "row_ratio", "ratio", target_column=F.col("col_index"), numerator_column=F.col("n"), denominator_columns=F.array("d"), multiplier=F.col("m"), tolerance=tolerance, score=score)


def column_shares(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """A ratio column as the share of a value column in its total row."""
    v = columns.where("not is_ratio and additive and numbers > 0").select("table_id", F.col("col_index").alias("n"))
    c = columns.where("is_ratio").join(v, "table_id").join(rows.where("is_total").select("table_id", F.col("row_index").alias("d")), "table_id")
    return spec_rows(c, "column_share_ratio", "ratio", target_column=F.col("col_index"), numerator_column=F.col("n"), denominator_row=F.col("d"), multiplier=100.0, tolerance=0.15)


def before_rows(rows: DataFrame) -> DataFrame:
    """rows with `before`: the last value row before each and the one before that (fewer where there are none)."""
    w = W.partitionBy("table_id").orderBy("row_index").rowsBetween(W.unboundedPreceding, -1)
    value = F.when(~F.col("is_ratio") & ~F.col("is_growth") & ~F.col("per_unit"), F.col("row_index"))
    r = rows.withColumn("__one", F.last(value, ignorenulls=True).over(w))
    pair = F.when(value.isNotNull(), F.struct(value.alias("a"), F.col("__one").alias("b")))
    r = r.withColumn("__two", F.last(pair, ignorenulls=True).over(w))
    return r.withColumn("before", F.when(F.col("__two").isNull(), F.array().cast("array<int>")).otherwise(F.array_compact(F.array("__two.a", "__two.b")))).drop("__one", "__two")


def ratio_rows(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """A ratio row from the two value rows before it, a row per person, case.. likewise as their quotient; a growth row from the value row before it and its neighbouring years."""
    cols = columns.where("numbers > 0").groupBy("table_id").agg(F.array_sort(F.collect_list("col_index")).alias("cols"))
    r = before_rows(rows).join(cols, "table_id")
    two = r.where("is_ratio and not is_growth and size(before) = 2").withColumn("flip", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("m", F.explode(F.array(F.lit(100.0), F.lit(1.0))))
    n, d = F.when(F.col("flip") == 0, F.col("before")[0]).otherwise(F.col("before")[1]), F.when(F.col("flip") == 0, F.col("before")[1]).otherwise(F.col("before")[0])
    pair = F.array(F.struct(F.col("row_index").alias("target_row"), F.col("before")[0].alias("source_row"), F.lit(None).cast("int").alias("value_row"), F.lit(None).cast("int").alias("weight_row")))
    years = columns.where("year is not null").groupBy("table_id").agg(F.array_sort(F.collect_list("col_index")).alias("years")).where("size(years) >= 2")
    g = r.where("is_growth and size(before) >= 1").join(years, "table_id")
    return spec_rows(two, "row_ratio_by_rows", "ratio", target_row=F.col("row_index"), columns=F.col("cols"), numerator_row=n, denominator_rows=F.array(d), multiplier=F.col("m"), tolerance=0.15).unionAll(
        spec_rows(r.where("per_unit and size(before) = 2"), "row_ratio_by_rows", "ratio", target_row=F.col("row_index"), columns=F.col("cols"), numerator_row=F.col("before")[0], denominator_rows=F.array(F.col("before")[1]), multiplier=1.0, tolerance=0.05)
    ).unionAll(
        spec_rows(g, "row_year_over_year_rate", "growth_rate", columns=F.col("years"), row_pairs=pair, tolerance=0.15)
    )


def component_ratio_rows(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """A ratio row as the share of a part in the part and its complement: the first two value rows among the three after it."""
    cols = columns.where("numbers > 0").groupBy("table_id").agg(F.array_sort(F.collect_list("col_index")).alias("cols"))
    w = W.partitionBy("table_id").orderBy("row_index").rowsBetween(1, 3)
    value = F.when(~F.col("is_ratio") & ~F.col("is_growth") & ~F.col("is_total"), F.col("row_index"))
    r = rows.withColumn("after", F.slice(F.array_sort(F.collect_list(value).over(w)), 1, 2)).where("is_ratio and not is_growth and size(after) = 2").join(cols, "table_id")
    return spec_rows(r, "row_ratio_by_rows", "ratio", target_row=F.col("row_index"), columns=F.col("cols"), numerator_row=F.col("after")[0], denominator_rows=F.col("after"), multiplier=100.0, tolerance=0.15)


def named_ratio_rows(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """A ratio row from the first value row before it with the same last label, in the row before it that most looks like a base."""
    cols = columns.where("numbers > 0").groupBy("table_id").agg(F.array_sort(F.collect_list("col_index")).alias("cols"))
    label = X.normalize(F.col("label"))
    base = F.when(label.contains("gdp"), 4).otherwise(0) + F.when(label.rlike("계|전체|대상|기준|인구|total|base|target|population"), 2).otherwise(0) - F.when(F.col("is_ratio") | F.col("is_growth"), 4).otherwise(0)
    r = rows.select("table_id", "row_index", "is_ratio", "is_growth", X.normalize(F.col("leaf_label")).alias("leaf"), base.alias("score")).where("leaf <> ''")
    t = r.where("is_ratio and not is_growth").select("table_id", "leaf", F.col("row_index").alias("target"))
    n = t.join(r.where("not is_ratio"), ["table_id", "leaf"]).where("row_index < target").groupBy("table_id", "target").agg(F.min("row_index").alias("n"))
    d = rows.select("table_id", "row_index", base.alias("score")).where("score >= 2")
    d = n.join(d, "table_id").where("row_index < target and row_index <> n").groupBy("table_id", "target", "n").agg(F.max(F.struct("score", "row_index"))["row_index"].alias("d"))
    return spec_rows(d.join(cols, "table_id"), "row_ratio_by_rows", "ratio", target_row=F.col("target"), columns=F.col("cols"), numerator_row=F.col("n"), denominator_rows=F.array("d"), multiplier=100.0, tolerance=0.15)


def year_row_changes(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """With at least three year rows: a change or rate column from the value column before it."""
    y = rows.where("year is not null").groupBy("table_id").agg(F.array_sort(F.collect_list("row_index")).alias("rows")).where("size(rows) >= 3")
    v = columns.where("not is_ratio and numbers > 0").select("table_id", F.col("col_index").alias("v"))
    key = X.normalize(F.col("head"))
    t = columns.where(key.rlike("증감|증가|change|growth")).join(y, "table_id").join(v, "table_id").where("v < col_index")
    best = t.groupBy("table_id", "col_index", "rows", "head").agg(F.max("v").alias("v"))
    rate = best.where(X.normalize(F.col("head")).rlike("률|율|rate"))
    amount = best.where(~X.normalize(F.col("head")).rlike("률|율|rate"))
    return spec_rows(rate, "year_rows_change_rate", "growth_rate", row_indices=F.col("rows"), value_column=F.col("v"), rate_column=F.col("col_index"), tolerance=0.15).unionAll(
        spec_rows(amount, "year_rows_change_amount", "change", row_indices=F.col("rows"), value_column=F.col("v"), change_column=F.col("col_index"))
    )


def always(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Metadata for every table; outliers for tables with a column of at least five numbers."""
    five = columns.where("numbers >= 5 and not is_total").groupBy("table_id").agg(F.array_sort(F.collect_list("col_index")).alias("cols"))
    return spec_rows(tables.select(F.col("id").alias("table_id")), "metadata_required", "metadata", confidence=1.0).unionAll(spec_rows(five, "outlier_columns", "outlier", columns=F.col("cols"), multiplier=20.0, confidence=0.7))


#: Name -> generator of candidate specs from (columns, rows, cells), the former two as structure() gives them.
GENERATORS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "header formulas": lambda columns, rows, cells: header_formulas(columns),
    "total columns": lambda columns, rows, cells: total_columns(columns),
    "sets of columns": lambda columns, rows, cells: column_combinations(columns, cells),
    "total rows": lambda columns, rows, cells: total_rows(columns, rows),
    "running sums": implicit_subtotals,
    "one total": wrapped_totals,
    "regions": lambda columns, rows, cells: region_totals(columns, rows),
    "ratios in a row": lambda columns, rows, cells: same_row_ratios(columns),
    "shares in a column": lambda columns, rows, cells: column_shares(columns, rows),
    "ratio rows": lambda columns, rows, cells: ratio_rows(columns, rows),
    "component ratios": lambda columns, rows, cells: component_ratio_rows(columns, rows),
    "named ratios": lambda columns, rows, cells: named_ratio_rows(columns, rows),
    "changes by year": lambda columns, rows, cells: year_row_changes(columns, rows),
}


def generator(name: str) -> Callable:
    """Decorator that adds a generator, or puts another one in the place of the one of that name."""

    def add(f: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> Callable:
        GENERATORS[name] = f
        return f

    return add


def candidates(cells: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """What the generators (all, or those named) make of the grids, one spec of each meaning."""
    columns, rows = map(cut, structure(cells))
    return dedupe(reduce(DataFrame.unionAll, (f(columns, rows, cells) for name, f in GENERATORS.items() if only is None or name in only)))


#: Name -> provider of specs for (cells, tables). A model's provider returns rows of edges.SPEC, which are scored as all others are.
PROVIDERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"heuristic": lambda cells, tables: inferred(cells, tables)}


def drafts(cells: DataFrame, tables: DataFrame, provider: str | Callable[[DataFrame, DataFrame], DataFrame] = "heuristic") -> DataFrame:
    """Specs with `source`: the provider's that the data bear out; a table for which it has none gets the heuristic's, as fallback."""
    if provider == "heuristic":
        return PROVIDERS["heuristic"](cells, tables).withColumn("source", F.lit("heuristic"))
    own = provider(cells, tables) if callable(provider) else PROVIDERS[provider](cells, tables)
    own = cut(inferred(cells, specs=own.where(edges.coordinates_exist())))
    rest = PROVIDERS["heuristic"](cells, tables).join(own.select("table_id").distinct(), "table_id", "left_anti")
    return own.withColumn("source", F.lit("model")).unionByName(rest.withColumn("source", F.lit("fallback")))


def dedupe(specs: DataFrame) -> DataFrame:
    """One spec of each meaning; region_total and column_sum of the same coordinates mean the same."""
    key = F.regexp_replace("spec_id", "^region_total", "column_sum")
    return specs.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc_nulls_last("confidence"), "type"))).where("__n = 1").drop("__n")


def scored(specs: DataFrame, cells: DataFrame, types: list[str] | None = None) -> DataFrame:
    """spec_id, checked, ratio, mean_difference of every spec that can be evaluated at all."""
    e = edges.evaluate(specs, cells, types)
    return e.groupBy("spec_id").agg(F.count("*").alias("checked"), F.avg(F.col("passed").cast("double")).alias("ratio"), F.avg(F.abs(F.col("current_value") - F.col("expected_value"))).alias("mean_difference"))


def confidence(ratio: Column) -> Column:
    return F.when(ratio >= 0.95, 0.96).when(ratio >= 0.8, 0.9).otherwise(0.76)


def inferred(cells: DataFrame, tables: DataFrame | None = None, specs: DataFrame | None = None) -> DataFrame:
    """The specs that the data bear out: ratio at least 0.6 with three checks or more, else 0.8; ratios always 0.8 with three, with two if they are of rows.

    Of specs for the same target the best stays: by ratio, checks, score, difference, fewest operands, then id.
    """
    # Candidates are written once: every compiler of the evaluation reads them.
    cells = cut(cells)
    specs = cut(candidates(cells) if specs is None else specs)
    types = [r["type"] for r in specs.select("type").distinct().collect()]  # at most as many as there are spec types
    s = specs.join(scored(specs, cells, types), "spec_id")
    ratio = F.col("check_group") == "ratio"
    s = s.where(F.when(ratio, (F.col("checked") >= F.when(F.col("type") == "row_ratio_by_rows", 2).otherwise(3)) & (F.col("ratio") >= 0.8)).otherwise(F.col("ratio") >= F.when(F.col("checked") >= 3, 0.6).otherwise(0.8)))
    w = W.partitionBy("table_id", "check_group", "target_row", "target_column", F.to_json("row_pairs"), "rate_column", "change_column").orderBy(F.desc("ratio"), F.desc("checked"), F.desc_nulls_last("score"), "mean_difference", F.size(F.coalesce("operand_rows", "operand_columns", F.array().cast("array<int>"))), "spec_id")
    best = s.withColumn("__n", F.row_number().over(w)).where("__n = 1").withColumn("confidence", F.coalesce("confidence", confidence(F.col("ratio")))).drop("__n", "checked", "mean_difference", "ratio")
    best = best.select(*edges.SPEC.names)
    return best if tables is None else best.unionAll(always(tables, structure(cells)[0]))


def profile_status(specs: DataFrame) -> DataFrame:
    """table_id, specs, status: needs_review without specific specs or with one of low confidence."""
    specific = ~F.col("type").isin("metadata_required", "outlier_columns")
    g = specs.groupBy("table_id").agg(F.count("*").alias("specs"), F.count_if(specific).alias("n"), F.min(F.when(specific, F.col("confidence"))).alias("least"))
    return g.select("table_id", "specs", F.when((F.col("n") == 0) | (F.col("least") < 0.7), "needs_review").otherwise("ready").alias("status"))


def overlay(specs: DataFrame, suppress: DataFrame, confidences: DataFrame, added: DataFrame) -> DataFrame:
    """Curated corrections: suppressed (table_id, type) go, confidences (spec_id, confidence) replace, added specs come last and win."""
    s = specs.join(suppress, ["table_id", "type"], "left_anti")
    s = s.join(confidences.withColumnRenamed("confidence", "__c"), "spec_id", "left").withColumn("confidence", F.coalesce("__c", "confidence")).drop("__c")
    return s.select(*edges.SPEC.names).join(added.select("spec_id"), "spec_id", "left_anti").unionByName(added)


def profiles(tables: DataFrame) -> DataFrame:
    """How each table gets its profile. tables: table_id, table_code, title, signature, turn (an int: the place of its delivery in time).

    From the tables of earlier turns: the same code and structure: reused; the same title and structure: inherited; else
    drafted. Of several the latest turn counts, in it the largest id. A table without a turn gets and gives nothing.
    """
    past = F.max(F.when(F.col("turn").isNotNull(), F.struct("turn", "table_id")))

    def latest(key: str) -> Column:
        w = W.partitionBy(key, "signature").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
        return F.when(F.col(key).isNotNull() & F.col("signature").isNotNull() & F.col("turn").isNotNull(), past.over(w)["table_id"])

    t = tables.withColumn("own", latest("table_code")).withColumn("akin", latest("title"))
    return t.select("table_id", F.coalesce("own", "akin").alias("profile_id"), F.when(F.col("own").isNotNull(), "reused").when(F.col("akin").isNotNull(), "inherited").otherwise("draft").alias("origin"))
