"""Problem 6: quantities recorded in different units and scales, brought to the common unit of their kind.

Every column of a grid gets its candidate units: the one in brackets in its header, else those that the table lists.
Where more than one is left, physical identities among the columns choose: for a = b * c (area = length * length, mass =
density * volume, or any list of identities given), the mean of log a - log b - log c over the rows is one number a
table, and the combination of candidate units whose factors bring it nearest to zero is taken; a second combination
about as near flags the solution as not unique, and a column without a unique unit is not converted. A single
candidate is the trivial solution, whose residual (p6_units) is a check of the unit as stated. Units inside a cell go
before its column's. Numbers are read and reckoned with exactly, as whole numbers and decimal places.

Defined results: cells that hold no number (marks for "no value", texts) have no row; a bracketed percentage after a
number is a remark; cells delivered twice are converted twice; null headers and units are no candidates; units of
other kinds have no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.grid import NUMBER, REMARK, plain_texts
from gridloom.functions.plainpoints import plain_array
from gridloom.session import cut, table

# Common unit of each kind; (kind, factor to it) of the base units; scales written before a base.
COMMON = {"persons": "명", "money": "원", "area": "m2", "length": "m", "weight": "kg", "cases": "건", "volume": "m3", "density": "kg/m3"}
BASES = {
    "명": ("persons", 1), "인": ("persons", 1), "persons": ("persons", 1), "person": ("persons", 1), "people": ("persons", 1), "명(persons)": ("persons", 1), "인(persons)": ("persons", 1),
    "원": ("money", 1), "won": ("money", 1), "krw": ("money", 1), "원(won)": ("money", 1), "원(krw)": ("money", 1),
    "m2": ("area", 1), "제곱미터": ("area", 1), "km2": ("area", 10**6), "제곱킬로미터": ("area", 10**6), "ha": ("area", 10**4), "헥타르": ("area", 10**4), "hectares": ("area", 10**4), "hectare": ("area", 10**4), "평": ("area", (400, 121)), "pyeong": ("area", (400, 121)),
    "m": ("length", 1), "미터": ("length", 1), "meters": ("length", 1), "metres": ("length", 1), "km": ("length", 1000), "킬로미터": ("length", 1000), "kilometers": ("length", 1000), "cm": ("length", (1, 100)), "센티미터": ("length", (1, 100)), "mm": ("length", (1, 1000)), "밀리미터": ("length", (1, 1000)),
    "kg": ("weight", 1), "킬로그램": ("weight", 1), "kilograms": ("weight", 1), "g": ("weight", (1, 1000)), "그램": ("weight", (1, 1000)), "t": ("weight", 1000), "톤": ("weight", 1000), "ton": ("weight", 1000), "tons": ("weight", 1000), "tonnes": ("weight", 1000),
    "건": ("cases", 1), "cases": ("cases", 1), "case": ("cases", 1), "건(cases)": ("cases", 1),
    "m3": ("volume", 1), "세제곱미터": ("volume", 1), "l": ("volume", (1, 1000)), "리터": ("volume", (1, 1000)), "kg/m3": ("density", 1), "t/m3": ("density", 1000), "g/cm3": ("density", 1000),
}
SCALES = {
    "": 1, "십": 10, "백": 100, "천": 10**3, "만": 10**4, "십만": 10**5, "백만": 10**6, "천만": 10**7, "억": 10**8, "십억": 10**9, "백억": 10**10, "천억": 10**11, "조": 10**12,
    "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12, "10thousand": 10**4, "100thousand": 10**5, "10million": 10**7, "100million": 10**8,
    "10": 10, "100": 100, "1,000": 10**3, "10,000": 10**4, "100,000": 10**5, "1,000,000": 10**6, "1000": 10**3, "10000": 10**4,
}
#: The kinds converted for p6_found.
KINDS = ("persons", "money", "area", "length", "weight", "cases")
#: Residuals this near to the best one leave a unit open (a factor of 1.05).
NEAR = 0.05
#: result kind = product of two factor kinds.
IDENTITIES = (("area", "length", "length"), ("weight", "density", "volume"))
#: Columns (two numbers and a known unit, none longer than some 20 letters) that may be broadcast: some 30 MB.
FEW = 250_000
#: Cells of one column that may meet in one task of a join.
HOT = 500_000


@lru_cache(maxsize=1)
def unit_rows() -> list[tuple[str, str, int, int]]:
    """(unit text as unit_key gives it, kind, numerator, denominator of its factor to the common unit); built by rule."""
    out = {}
    for scale, times in SCALES.items():
        for base, (kind, factor) in BASES.items():
            num, den = factor if isinstance(factor, tuple) else (factor, 1)
            out[scale + base] = (kind, num * times, den)
            if base in ("krw", "won"):
                out[base + scale] = (kind, num * times, den)
    return [(k, *v) for k, v in out.items()]


def unit_table(spark: SparkSession) -> DataFrame:
    """unit, kind, num, den: some 1,500 rows, whatever the data."""
    return spark.createDataFrame(unit_rows(), "unit string, kind string, num long, den long")


def unit_key(text: Column) -> Column:
    """A unit as written, in one spelling: squared and scaled signs spelled out, lower case, no blanks, no 'unit:' before it."""
    t = F.lower(text)
    for sign, plain in (("㎡", "m2"), ("㎢", "km2"), ("㏊", "ha"), ("㎞", "km"), ("㎝", "cm"), ("㎜", "mm"), ("㎏", "kg"), ("㎥", "m3"), ("²", "2"), ("³", "3"), ("^2", "2"), ("^3", "3")):
        t = F.replace(t, F.lit(sign), F.lit(plain))
    t = F.regexp_replace(t, r"(?U)\s+", "")
    return F.regexp_replace(t, r"^(?:단위|unit)[:：]?", "")


def listed_units(text: Column) -> Column:
    """The units that a table's plain unit text lists, as keys; commas inside of numbers don't part."""
    t = F.trim(text)
    t = F.when(t.rlike(r"(?i)^\(\s*(?:단위|unit)[^()]*(?:\([^()]*\)[^()]*)*\)$"), F.regexp_replace(t, r"^\(|\)$", "")).otherwise(t)
    parts = F.transform(F.split(t, r",\s+|,(?![0-9]{3})|;|·"), unit_key)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def bracket_unit(head: Column) -> Column:
    """The unit in the last brackets of a header's first line that has any, as key; null if there is none."""
    found = F.regexp_extract_all(head, F.lit(r"\(((?:[^()]|\([^()]*\))*)\)"), F.lit(1))
    keys = F.filter(F.transform(found, unit_key), lambda x: (x != "") & ~x.rlike(r"^[a-fh-knopqrsu-z0-9+*/=.-]$|^[a-z][+*/=-].*$"))
    return F.try_element_at(keys, F.lit(1))


_WHOLE = rf"(?s)^(?P<n>{NUMBER})\s*(?P<u>\S.*)?$"
_STORED = r"^(?P<n>-?[0-9]+(?:\.[0-9]+)?)(?:[eE](?P<e>[+-]?[0-9]+))?$"
_LARGE = rf"^(?:(?P<a>{NUMBER})\s*조)?\s*(?:(?P<b>{NUMBER})\s*억)?\s*(?:(?P<c>{NUMBER})\s*만)?\s*(?P<d>{NUMBER})?\s*원$"
#: Digits that a long holds for certain, and its power of ten.
LONG = 18


def _groups(text: pa.Array, pattern: str) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(rows that match, the groups' texts there)."""
    got = pc.extract_regex(text, pattern)
    rows = np.flatnonzero(np.asarray(got.is_valid()))
    got = got.take(pa.array(rows))
    return rows, {f.name: got.field(i) for i, f in enumerate(got.type)}


def _digits(number: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all digits of number texts without leading zeros, decimal places, whether negative)."""
    plain = pc.replace_substring(pc.replace_substring(number, ",", ""), "+", "")
    negative = np.asarray(pc.starts_with(plain, "-"))
    point = np.asarray(pc.find_substring(plain, "."))
    length = np.asarray(pc.utf8_length(plain))
    digits = pc.utf8_ltrim(pc.replace_substring_regex(plain, "[.-]", ""), "0")
    return digits, np.where(point < 0, 0, length - point - 1).astype(np.int32), negative


def _longs(digits: pa.Array) -> np.ndarray:
    """Digits as long, -1 where there are more than LONG."""
    short = np.asarray(pc.utf8_length(digits)) <= LONG
    return np.where(short, np.asarray(pc.cast(pc.if_else(pa.array(short), pc.utf8_lpad(digits, 1, "0"), "0"), pa.int64())), -1)


def _sums(parts: list[pa.Array]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Digits, places and sign of sums of 조, 억, 만 and ones; a sum too large for a long is reckoned by itself."""
    each = [_digits(x) for x in parts]
    places = np.max([p for _, p, _ in each], axis=0)
    longs = [_longs(d) for d, _, _ in each]
    powers = [places - p + k for (_, p, _), k in zip(each, (12, 8, 4, 0))]
    fits = np.all([(v >= 0) & (v < 10.0 ** (LONG - 1 - np.minimum(w, LONG - 1))) for v, w in zip(longs, powers)], axis=0)
    total = sum(np.where(fits, v, 0) * 10 ** np.where(fits, w, 0).astype(np.int64) for v, w in zip(longs, powers))
    out = [str(x) for x in total.tolist()]
    for i in np.flatnonzero(~fits).tolist():
        out[i] = str(sum(int(d[i].as_py() or 0) * 10 ** int(w[i]) for (d, _, _), w in zip(each, powers)))
    negative = np.zeros(len(out), bool)
    for (d, _, n), x in zip(reversed(each), reversed(parts)):
        negative = np.where(np.asarray(pc.utf8_length(x)) > 0, n, negative)
    return out, places, negative


def _quantities(text: pa.Array, stored: pa.Array) -> dict[str, object]:
    """rows that hold a number, and of each: digits as long (-1 if wide has them), wide, places, negative, in_cell."""
    text = pc.utf8_trim_whitespace(plain_array(text))
    remark = pc.fill_null(pc.match_substring(text, "%"), False)
    if pc.any(remark).as_py():
        text = pc.utf8_trim_whitespace(pc.if_else(remark, pc.replace_substring_regex(text, REMARK, ""), text))
    blank = np.asarray(pc.fill_null(pc.equal(text, ""), True))
    none = np.flatnonzero(blank)
    at, got = _groups(text, _WHOLE)
    at2, own = _groups(pc.cast(stored.take(pa.array(none)), pa.string()), _STORED)
    rows = np.concatenate([at, none[at2]])
    digits, places, negative = _digits(pa.concat_arrays([got["n"], own["n"]]))
    power = np.asarray(pc.cast(pc.if_else(pc.equal(own["e"], ""), "0", pc.replace_substring(own["e"], "+", "")), pa.int32()))
    places[len(at):] -= power
    unit = pa.concat_arrays([got["u"], pa.array([""] * len(at2), pa.string())])
    large = np.flatnonzero(np.asarray(pc.fill_null(pc.and_(pc.ends_with(text, "원"), pc.match_substring_regex(text, "[조억만]")), False)))
    if len(large):
        at3, parts = _groups(text.take(pa.array(large)), _LARGE)
        parts = [parts[k] for k in "abcd"]
        several = sum(np.asarray(pc.utf8_length(x)) > 0 for x in parts) > 1
        at3, parts = large[at3[several]], [x.filter(pa.array(several)) for x in parts]
        out, p, n = _sums(parts)
        keep = ~np.isin(rows, at3)
        digits = pa.concat_arrays([digits.filter(pa.array(keep)), pa.array(out, pa.string())])
        places, negative = np.concatenate([places[keep], p]), np.concatenate([negative[keep], n])
        unit = pa.concat_arrays([unit.filter(pa.array(keep)), pa.array(["*원"] * len(at3), pa.string())])
        rows = np.concatenate([rows[keep], at3])
    longs = _longs(digits)
    return {"rows": rows, "digits": longs, "wide": pc.if_else(pa.array(longs < 0), digits, pa.scalar(None, pa.string())), "places": places.astype(np.int32), "negative": negative, "in_cell": unit}


def quantities(cells: DataFrame) -> DataFrame:
    """cells without text_value and numeric_value, with digits, wide, places, negative, in_cell: the cells that hold a number.

    The number is digits / 10 ** places; digits is -1 if there are more than LONG, then `wide` has them as text. in_cell
    is the key of a unit written in the cell, `*원` for a sum of 조, 억 and 만.
    """
    rest = [f for f in cells.schema.fields if f.name not in ("text_value", "numeric_value")]
    more = {"digits": T.LongType(), "wide": T.StringType(), "places": T.IntegerType(), "negative": T.BooleanType(), "in_cell": T.StringType()}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _quantities(b.column("text_value"), b.column("numeric_value"))
            kept = b.take(pa.array(got["rows"], pa.int64()))
            columns = [kept.column(f.name) for f in rest] + [x if isinstance(x := got[k], pa.Array) else pa.array(x) for k in more]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in rest), *more])

    out = cells.mapInArrow(kernel, T.StructType([*rest, *(T.StructField(k, t) for k, t in more.items())]))
    return out.withColumn("in_cell", F.when(F.col("in_cell") == "", "").otherwise(unit_key(F.col("in_cell"))))


def rounded(df: DataFrame, out: str) -> DataFrame:
    """df (digits, wide, places, negative, num, den) with digits / 10 ** places * num / den, rounded half up, as long `out`; null beyond its range or 38 digits."""
    tens = ", ".join(f"{10**i}L" for i in range(7))
    df = df.withColumn("__few", F.expr("digits between 0 and 999999999 and num <= 1000000000 and places between 0 and 6"))
    few = f"(2 * digits * num + den * array({tens})[places]) div (2 * den * array({tens})[places])"
    whole = "decimal(38,0)"
    ten = lambda n: f"try_cast(concat('1', repeat('0', greatest({n}, 0))) as {whole})"
    top = f"cast(try_multiply(cast(try_multiply(try_cast(coalesce(wide, cast(digits as string)) as {whole}), cast(num as {whole})) as {whole}), {ten('-places')}) as {whole})"
    low = f"cast(try_multiply(cast(den as {whole}), {ten('places')}) as {whole})"
    df = df.withColumns({"__a": F.expr(f"case when not __few then {top} end"), "__d": F.expr(f"case when not __few then {low} end")})
    df = df.withColumns({"__a": F.expr(f"cast(try_add(try_add(__a, __a), __d) as {whole})"), "__d": F.expr(f"cast(try_add(__d, __d) as {whole})")})
    many = "try_cast(try_divide(try_subtract(__a, try_mod(__a, __d)), __d) as long)"
    value = F.expr(f"case when __few then {few} else {many} end")
    return df.withColumn(out, F.when(F.col("negative"), -value).otherwise(value)).drop("__few", "__a", "__d")


def column_units(heads: DataFrame) -> DataFrame:
    """table_id, col_index, own: the unit in the brackets of each column's header (plain cells), if there is one; the lowest row that has one counts."""
    heads = heads.where("col_index >= 1").select("table_id", "col_index", "row_index", bracket_unit(F.col("text_value")).alias("own"))
    return heads.where("own is not null").groupBy("table_id", "col_index").agg(F.max_by("own", "row_index").alias("own"))


def known_units(tables: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own, listed): table_id, col_index, own of the columns whose header has a unit; table_id, units of the tables that list any."""
    own = column_units(plain_texts(cells.where("is_header"), "text_value"))
    listed = plain_texts(tables.select(F.col("id").cast("long").alias("table_id"), F.col("unit").cast("string").alias("unit")).where("unit is not null"), "unit")
    return own, listed.select("table_id", listed_units(F.col("unit")).alias("units")).where("size(units) > 0")


def combinations(candidates: DataFrame, units: DataFrame, identities=IDENTITIES) -> DataFrame:
    """Every combination of candidate units (table_id, col_index, unit) of three columns of a table that an identity ties: a = b * c."""
    kinds = candidates.sparkSession.createDataFrame([list(x) for x in identities], "a_kind string, b_kind string, c_kind string")
    c = candidates.join(F.broadcast(units), "unit").withColumn("f", F.log(F.col("num") / F.col("den")))
    side = lambda p: c.select("table_id", *[F.col(x).alias(f"{p}_{x}") for x in ("col_index", "unit", "kind", "f")])
    trios = side("a").join(F.broadcast(kinds), "a_kind").join(side("b"), ["table_id", "b_kind"]).join(side("c"), ["table_id", "c_kind"])
    trios = trios.where("a_col_index <> b_col_index and a_col_index <> c_col_index and (b_col_index < c_col_index or b_kind <> c_kind and b_col_index <> c_col_index)")
    return trios


def solve(values: DataFrame, candidates: DataFrame, units: DataFrame, identities=IDENTITIES, near: float = NEAR, stated: bool = False) -> DataFrame:
    """table_id, col_index, unit, residual, is_unique for the columns with more than one candidate; of all columns in an identity, if `stated`.

    values: table_id, row_index, col_index, value; candidates: table_id, col_index, unit (one row per candidate, also of
    columns with a single one, for which the residual is a check of the unit as stated). Every combination within one
    identity is scored by its log residual from one mean a trio of columns; combinations of different columns never meet.
    """
    many = candidates.groupBy("table_id", "col_index").agg(F.count("*").alias("n")).where("n > 1").select("table_id", "col_index")
    if not stated:
        candidates = candidates.join(many.select("table_id").distinct(), "table_id", "left_semi")
    return _best(values, combinations(candidates, units, identities), None if stated else many, near)


def _best(values: DataFrame, trios: DataFrame, only: DataFrame | None, near: float) -> DataFrame:
    """The least residual of each column (of `only`, if given) and its unit, from the combinations and the grids' values."""
    trios = trios.hint("merge")
    used = trios.select("table_id", "a_col_index", "b_col_index", "c_col_index").distinct().hint("merge")
    v = values.join(used.select("table_id").distinct(), "table_id", "left_semi").where("value > 0").select("table_id", "row_index", "col_index", F.log("value").alias("v"))
    for p in "abc":
        used = used.join(v.withColumnsRenamed({"col_index": f"{p}_col_index", "v": f"{p}_v"}), ["table_id", f"{p}_col_index"] + (["row_index"] if p != "a" else []))
    means = used.groupBy("table_id", "a_col_index", "b_col_index", "c_col_index").agg(F.avg(F.col("a_v") - F.col("b_v") - F.col("c_v")).alias("m"))
    scored = trios.join(means, ["table_id", "a_col_index", "b_col_index", "c_col_index"]).withColumn("residual", F.abs(F.col("m") + F.col("a_f") - F.col("b_f") - F.col("c_f")))
    each = scored.select("table_id", "residual", F.explode(F.array(*[F.struct(F.col(f"{p}_col_index").alias("col_index"), F.col(f"{p}_unit").alias("unit")) for p in "abc"])).alias("x")).select("table_id", "x.*", "residual")
    best = each.groupBy("table_id", "col_index", "unit").agg(F.min("residual").alias("residual"))
    best = best if only is None else best.join(only.hint("merge"), ["table_id", "col_index"], "left_semi")
    top = best.groupBy("table_id", "col_index").agg(F.array_sort(F.collect_list(F.struct("residual", "unit"))).alias("tops"))
    return top.select("table_id", "col_index", F.col("tops")[0]["unit"].alias("unit"), F.col("tops")[0]["residual"].alias("residual"), ((F.size("tops") == 1) | (F.try_element_at("tops", F.lit(2))["residual"] - F.col("tops")[0]["residual"] > near)).alias("is_unique"))


def _stated(tables: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grid cells as far as they are needed, own, listed)."""
    cells = cells.where("col_index >= 1").select(F.col("id").cast("long").alias("id"), F.col("table_id").cast("long").alias("table_id"), F.col("row_index").cast("int").alias("row_index"), F.col("col_index").cast("int").alias("col_index"), F.col("text_value").cast("string").alias("text_value"), "numeric_value", F.coalesce("is_header", F.lit(False)).alias("is_header"))
    own, listed = known_units(tables, cells)
    return cells, cut(own), cut(listed)


def _numbers(cells: DataFrame) -> DataFrame:
    data = cells.where(~F.col("is_header") & F.coalesce(F.col("text_value").rlike(r"\d|[^ -~]"), F.col("numeric_value").isNotNull())).drop("is_header")
    return quantities(data)


def column_candidates(cells: DataFrame, own: DataFrame, listed: DataFrame) -> DataFrame:
    """table_id, col_index, n (its cells), own, units of every column that holds data and whose header or table states a unit.

    Here and below, joins of cut rows ask for a merge: their files are packed, and Spark, which goes by the files' size,
    would broadcast what is many times larger in memory.
    """
    columns = cells.where(~F.col("is_header")).groupBy("table_id", "col_index").agg(F.count("*").alias("n"))
    return cut(columns.join(listed.hint("merge"), "table_id", "left").join(own.hint("merge"), ["table_id", "col_index"], "left").where("own is not null or units is not null"))


def of_columns(df: DataFrame, columns: DataFrame, how: str, few: int | None = None, hot: int | None = None) -> DataFrame:
    """df (id, table_id, col_index, ...) joined to `columns` (table_id, col_index, n, ... of a bounded width; cut, so that counting it reads no data), without n.

    Up to `few` columns are broadcast, whatever the size of the tables. More are joined by shuffle, where the cells of a
    column of more than `hot` cells are spread by their ids; only such columns are repeated, and there is at most one for
    every `hot` cells.
    """
    few, hot = FEW if few is None else few, HOT if hot is None else hot
    on = ["table_id", "col_index"]
    if columns.count() <= few:
        return df.join(F.broadcast(columns.drop("n")), on, how)
    salts = F.ceil(F.col("n") / hot).cast("int")
    spread = columns.where(F.col("n") > hot).select(*on, salts.alias("__salts")).distinct()
    df = df.join(F.broadcast(spread), on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")
    columns = columns.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).drop("n")
    return df.join(columns.hint("merge"), [*on, "__salt"], how).drop("__salt")


def solved_units(cells: DataFrame, columns: DataFrame, units: DataFrame, identities=IDENTITIES, stated: bool = False) -> DataFrame:
    """solve() for the columns of grids, from the units their headers and tables state (column_candidates); values are read of columns in an identity alone."""
    kept = columns if stated else columns.where("size(units) > 1")
    candidates = cut(kept.select("table_id", "col_index", F.explode(F.coalesce(F.when(F.col("own").isNotNull(), F.array("own")), "units")).alias("unit")).distinct())
    many = None
    if not stated:  # a table with one candidate a column has nothing to choose
        many = cut(candidates.groupBy("table_id", "col_index").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
        candidates = candidates.join(many.select("table_id").distinct().hint("merge"), "table_id", "left_semi")
    trios = cut(combinations(candidates, units, identities))
    tied = trios.select("table_id", F.explode(F.array(*[f"{p}_col_index" for p in "abc"])).alias("col_index")).distinct()
    tied = cut(tied.hint("merge").join(columns.select("table_id", "col_index", "n").distinct(), ["table_id", "col_index"]))
    values = of_columns(_numbers(cells), tied, "inner").where("in_cell = ''")
    value = F.coalesce("wide", F.col("digits").cast("string")).cast("double") / F.pow(F.lit(10.0), F.col("places"))
    return _best(values.select("table_id", "row_index", "col_index", F.when(F.col("negative"), -value).otherwise(value).alias("value")), trios, many, NEAR)


def converted(spark: SparkSession, tables: DataFrame, cells: DataFrame, identities=IDENTITIES) -> DataFrame:
    """cell_id, kind, unit, common_unit, common_value (rounded half up), factor_is_one: every cell that holds a number in a known unit.

    common_value is null where the number has more than 38 digits or the value is beyond a bigint.
    """
    cells, own, listed = _stated(tables, cells)
    units = unit_table(spark)
    columns = column_candidates(cells, own, listed)
    chosen = cut(solved_units(cells, columns, units, identities).where("is_unique").select("table_id", "col_index", F.col("unit").alias("solved")))
    # What a column's numbers are in: the header's unit, the only one listed, or the one that the identities choose. One
    # that isn't known gives no row, so that it needn't be joined.
    stated = columns.join(chosen.hint("merge"), ["table_id", "col_index"], "left").select("table_id", "col_index", "n", F.coalesce("own", F.when(F.size("units") == 1, F.col("units")[0]), "solved").alias("unit"))
    stated = cut(stated.join(F.broadcast(units.select("unit")), "unit").select("table_id", "col_index", "n", F.col("unit").alias("stated")))
    data = of_columns(_numbers(cells).drop("row_index"), stated, "left")
    data = data.withColumn("unit", F.when(F.col("in_cell") != "", F.regexp_replace("in_cell", r"^\*", "")).otherwise(F.col("stated"))).join(F.broadcast(units), "unit")
    data = rounded(data, "common_value")
    common = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in COMMON.items()])
    return data.select(F.col("id").alias("cell_id"), "kind", "unit", common.alias("common_unit"), "common_value", ((F.col("num") == F.col("den")) & ~F.col("in_cell").startswith("*")).alias("factor_is_one"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = converted(spark, table(spark, sf_dir, "stat_tables"), table(spark, sf_dir, "stat_table_cells"))
    return found.where(F.col("kind").isin(*KINDS) & ~F.col("factor_is_one")).select("cell_id", "common_unit", "common_value")


def p6_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_id, col_index, unit, residual, is_unique of every column that an identity ties to others."""
    cells, own, listed = _stated(table(spark, sf_dir, "stat_tables"), table(spark, sf_dir, "stat_table_cells"))
    return solved_units(cells, column_candidates(cells, own, listed), unit_table(spark), stated=True).withColumn("residual", F.round("residual", 6))
