"""Problem 1: what changed between consecutive full snapshots.

Only hashes and numbers of cells are shuffled. Cells, with their texts hashed in the scan, are bucketed by table and
block of BLOCK rows, so that a table of any size is many buckets; a block also gets its table's last header row and its
snapshot. Each bucket is sorted in numpy and becomes compact records (128-bit key hash, sum and count of 64-bit value
hashes, version, handle). These are bucketed by key hash, and each bucket finds added, removed and changed keys as set
differences with searchsorted. Full texts are fetched for differing records alone: the code for p1_found, all values of
both versions for p1_values. That rows of equal hashes are equal rests on the 64-bit hashes and the count.

Defined results: an empty snapshot makes all records of its neighbour added or removed; a key occurring more than once
in a version counts once, with all of its rows' values; null values equal null values; of a cell delivered twice the
smallest id stands; cells without an id, a table or a place are in no grid; rows without a label have no key and no case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.grid import deduplicated, number_of, plain_texts, says_nothing
from gridloom.session import buckets, cut, parallel, table

#: Rows of a table in one bucket of the first shuffle.
BLOCK = 20_000


def _differences(k1: np.ndarray, k2: np.ndarray, version: np.ndarray, h: np.ndarray, handle: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Handle, version and kind (0 added, 1 removed, 2 changed) of the differing records of one partition.

    `before`: the previous version is comparable with the record's; `after`: the next one is.
    """
    order = np.lexsort((k2, k1))
    k1, k2, version, h, handle, before, after = (x[order] for x in (k1, k2, version, h, handle, before, after))
    new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(k1) else np.zeros(0, bool)
    key = np.cumsum(new)  # dense, ascending, the same for the same 128 bits
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    for v in np.unique(version):
        now, old, nxt = (np.flatnonzero(version == x) for x in (v, v - 1, v + 1))

        def find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Place of each key of a among those of b, and whether it is there."""
            if not len(b):
                return np.zeros(len(a), np.int64), np.zeros(len(a), bool)
            p = np.minimum(np.searchsorted(key[b], key[a]), len(b) - 1)
            return p, key[b[p]] == key[a]

        p, there = find(now, old)
        out.append((now[~there & before[now]], 0, v))
        both = now[there & before[now]]
        out.append((both[h[both] != h[old[p[there & before[now]]]]], 2, v))
        _, there = find(now, nxt)
        out.append((now[~there & after[now]], 1, v + 1))
    rows = [x for x in out if len(x[0])]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    return (np.concatenate([handle[i] for i, _, _ in rows]), np.concatenate([np.full(len(i), v, np.int64) for i, _, v in rows]), np.concatenate([np.full(len(i), k, np.int8) for i, k, _ in rows]))


KINDS = ("added", "removed", "changed")
RECORD = "k1 long, k2 long, version long, h long, handle long, source long, before boolean, after boolean"
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    """The columns of all batches; null numbers are 0."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return None
    t = pa.Table.from_batches(got)
    return {c: (t.column(c) if not t.column(c).null_count else t.column(c).fill_null(0)).to_numpy() for c in t.column_names}


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group starts in rows sorted by the keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two 64-bit hashes, in this order."""
    with np.errstate(over="ignore"):
        x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b.view(np.uint64) ^ (b.view(np.uint64) >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def _combined(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Records of one key and version as one: hashes added up, the smallest handle with its source."""
    order = np.lexsort((c["handle"], c["version"], c["k2"], c["k1"]))
    c = {k: v[order] for k, v in c.items()}
    at = _starts(c["k1"], c["k2"], c["version"])
    with np.errstate(over="ignore"):
        h = np.add.reduceat(c["h"], at) if len(at) else c["h"]
    return {k: v[at] for k, v in c.items()} | {"h": h}


def _changes(records: DataFrame, n: int) -> DataFrame:
    """handle, source, version, change_kind, was, was_source of the differing records; records has RECORD's columns.

    was and was_source are handle and source of a changed record in the version before.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (c := _gathered(batches)) is None:
            return
        c = _combined(c)
        at, v, kind = _differences(c["k1"], c["k2"], c["version"], c["h"], np.arange(len(c["k1"])), c["before"], c["after"])
        was, none = np.maximum(at - 1, 0), kind != 2  # records are in order of key and version
        yield pa.RecordBatch.from_arrays(
            [pa.array(c["handle"][at]), pa.array(c["source"][at]), pa.array(v), pa.array(np.array(KINDS)[kind].tolist(), pa.string()), pa.array(c["handle"][was], mask=none), pa.array(c["source"][was], mask=none)],
            names=["handle", "source", "version", "change_kind", "was", "was_source"],
        )

    return records.repartition(n, "k1").mapInArrow(kernel, "handle long, source long, version long, change_kind string, was long, was_source long")


def snapshot_changes(records: DataFrame, key: list[str], row_hash: Column, version: str, handle: str, before: Column | None = None, after: Column | None = None) -> DataFrame:
    """Differing records of consecutive versions: handle (of the version that has the record), version (the later one), change_kind.

    Rows of one (key, version) are one record, whose hash is the sum of theirs; `before` and `after` tell whether the
    version before and after a record's is to be compared with it (by default it is).
    """
    k = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key]
    compact = records.select(
        F.xxhash64(*k).alias("k1"), F.xxhash64(F.lit(1), *k).alias("k2"), F.col(version).cast("long").alias("version"), row_hash.alias("h"), F.col(handle).cast("long").alias("handle"),
        F.lit(0).cast("long").alias("source"), (F.lit(True) if before is None else before).alias("before"), (F.lit(True) if after is None else after).alias("after"),
    )
    return _changes(compact, parallel(records.sparkSession)).select("handle", "version", "change_kind")


def snapshot_reports(reports: DataFrame) -> DataFrame:
    """year, report_id of each year's snapshot: not archived, latest imported_at, then the largest id."""
    return reports.where(~F.col("is_archived") & F.col("year").isNotNull() & F.col("imported_at").isNotNull()).groupBy("year").agg(F.max_by("id", F.struct("imported_at", "id")).alias("report_id"))


def snapshot_tables(reports: DataFrame, tables: DataFrame) -> DataFrame:
    """table_id, year, code, before, after: the tables of the snapshots whose code is in the snapshot of the year before or after too."""
    t = tables.select(F.col("id").alias("table_id"), "report_id", "code").join(F.broadcast(snapshot_reports(reports)), "report_id")  # a row a year
    codes = t.groupBy("code").agg(F.collect_set("year").alias("years"))  # a set as large as there are years
    t = t.join(codes, "code")
    t = t.select("table_id", "year", "code", F.array_contains("years", F.col("year") - 1).alias("before"), F.array_contains("years", F.col("year") + 1).alias("after"))
    return t.where("before or after")


def _value_hash(text: Column) -> Column:
    """Hash of a value's meaning: the number it is, else its text; null if it says nothing."""
    number = number_of(text)
    return F.when(~says_nothing(text), F.when(number.isNotNull(), F.xxhash64(F.lit("n"), number + F.lit(0.0))).otherwise(F.xxhash64(F.lit("t"), text)))


#: kind 0: the table's snapshot (a: before + 2 * after, row: year, h and h2: of the code); 1: a cell of its last header
#: row (h: of the text); 2: a label (h and h2: of the text); 3: a value (h). A label or value that says nothing is 10 more.
SILENT = 10


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of whole buckets to RECORDs, one for each key of a bucket."""
    if (c := _gathered(batches)) is None:
        return
    c["said"], c["kind"] = c["kind"] < SILENT, c["kind"] % SILENT
    order = np.lexsort((c["id"], c["col"], c["row"], c["kind"], c["block"], c["table_id"]))
    c = {k: v[order] for k, v in c.items()}
    of = _starts(c["table_id"], c["block"])
    group = np.repeat(np.arange(len(of)), np.diff(np.append(of, len(order))))
    first = _starts(c["table_id"], c["block"], c["kind"], c["row"], c["col"])  # the smallest id of a place stands
    c, group = {k: v[first] for k, v in c.items()}, group[first]
    meta, heads, labels, values = (np.flatnonzero(c["said"] & (c["kind"] == k)) for k in range(4))
    where = np.full(len(of), -1)
    where[group[meta]] = meta
    labels = labels[where[group[labels]] >= 0]
    if not len(labels):
        return
    # A value's column is known by its header's text; a missing or empty header has hash 0.
    place = lambda i: group[i] << np.int64(32) | c["col"][i]
    p = np.minimum(np.searchsorted(place(heads), place(values)), max(len(heads) - 1, 0))
    head = np.zeros(len(values), np.int64)
    if len(heads):
        head = np.where(place(heads)[p] == place(values), c["h"][heads[p]], 0)
    row = lambda i: group[i] << np.int64(32) | c["row"][i]
    at = np.minimum(np.searchsorted(row(labels), row(values)), len(labels) - 1)
    known = row(labels)[at] == row(values)
    h = np.zeros(len(labels), np.int64)
    with np.errstate(over="ignore"):  # the sum is over 64 bits; the constant counts the values
        np.add.at(h, at[known], _mixed(head[known], c["h"][values[known]]) + np.int64(0x5851F42D4C957F2D))
    m = where[group[labels]]
    out = _combined({
        "k1": _mixed(c["h"][m], c["h"][labels]), "k2": _mixed(c["h2"][m], c["h2"][labels]), "version": c["row"][m].astype(np.int64), "h": h, "handle": c["id"][labels],
        "source": c["table_id"][labels], "before": c["col"][m] & 1 > 0, "after": c["col"][m] & 2 > 0,
    })
    yield pa.RecordBatch.from_arrays([pa.array(out[k]) for k in _NAMES], names=_NAMES)


def yearbook_records(t: DataFrame, cells: DataFrame) -> DataFrame:
    """RECORDs of the grids of the tables t (of snapshot_tables)."""
    cells = cells.where("id is not null and table_id is not null and row_index is not null and col_index is not null").select(
        F.col("id").cast("long").alias("id"), F.col("table_id").cast("long").alias("table_id"), F.col("row_index").cast("int").alias("row"), F.col("col_index").cast("int").alias("col"),
        F.col("text_value").cast("string").alias("text"), F.coalesce("is_header", F.lit(False)).alias("is_header"),
    )
    # Of each table its blocks and its last header row: two numbers, combined before they are shuffled.
    size = cells.groupBy("table_id").agg(F.max("row").alias("rows"), F.max(F.when(F.col("is_header"), F.col("row"))).alias("last"))
    blocks = size.withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.col("rows") / BLOCK), F.lit(0)).cast("int"))))
    kind = lambda k: F.lit(k).cast("byte").alias("kind")
    none = F.lit(None).cast("long")
    meta = t.join(blocks.select("table_id", "block"), "table_id").select(
        "table_id", "block", kind(0), F.col("year").cast("int").alias("row"), (F.col("before").cast("int") + 2 * F.col("after").cast("int")).alias("col"), F.lit(0).cast("long").alias("id"),
        F.xxhash64("code").alias("h"), F.xxhash64(F.lit(1), "code").alias("h2"),
    )
    heads = plain_texts(cells.where("is_header").drop("is_header"), "text").withColumn("text", F.trim("text"))
    heads = heads.join(blocks, "table_id").where("row = last").select("table_id", "block", kind(1), "row", "col", "id", F.when(F.col("text") != "", F.xxhash64("text")).otherwise(0).alias("h"), none.alias("h2"))
    data = plain_texts(cells.where("not is_header and col >= 0").drop("is_header"), "text").withColumn("text", F.trim("text"))
    data = data.withColumn("block", F.greatest(F.floor(F.col("row") / BLOCK), F.lit(0)).cast("int"))
    label = F.col("col") == 0
    data = data.withColumns({"h": F.when(~label, _value_hash(F.col("text"))).when(F.col("text") != "", F.xxhash64("text")), "h2": F.when(label, F.xxhash64(F.lit(1), "text"))})
    data = data.select("table_id", "block", (F.when(label, 2).otherwise(3) + F.when(F.col("h").isNull(), SILENT).otherwise(0)).cast("byte").alias("kind"), "row", "col", "id", "h", "h2")
    return meta.unionAll(heads).unionAll(data).repartition(buckets(cells), "table_id", "block").mapInArrow(_records, RECORD)


def yearbook_changes(spark: SparkSession, reports: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """year, code, label_cell_id, change_kind of every data row that differs from the snapshot of the year before; table_id, was, was_table: where it is, and was.

    Two values are the same if they are the same number, the same plain text, or both say nothing; a column that is
    missing says nothing.
    """
    t = snapshot_tables(reports, tables)
    found = _changes(yearbook_records(t, cells), buckets(cells))
    named = found.join(t.select(F.col("table_id").alias("source"), "code"), "source")
    return named.select(F.col("version").cast("int").alias("year"), "code", F.col("handle").alias("label_cell_id"), "change_kind", F.col("source").alias("table_id"), "was", F.col("was_source").alias("was_table"))


def changed_values(found: DataFrame, cells: DataFrame) -> DataFrame:
    """year, code, label_cell_id, change_kind, is_new, cell_id, col_index, text_value: the values of the differing records (of yearbook_changes) in both versions.

    A record's rows are all rows of its table with its plain label.
    """
    known = ["year", "code", "label_cell_id", "change_kind"]
    sides = found.select(*known, F.explode(F.array(F.struct("table_id", F.col("label_cell_id").alias("id"), (F.col("change_kind") != "removed").alias("is_new")), F.struct(F.col("was_table").alias("table_id"), F.col("was").alias("id"), F.lit(False).alias("is_new")))).alias("s"))
    sides = cut(sides.select(*known, "s.*").where("id is not null"))
    data = cells.where("not coalesce(is_header, false) and table_id is not null and row_index is not null")
    labels = plain_texts(data.where("col_index = 0").select("id", "table_id", "row_index", F.col("text_value").alias("label")), "label").withColumn("label", F.trim("label"))
    labels = labels.join(sides.select("table_id").distinct(), "table_id", "left_semi")
    rows = sides.join(labels, ["table_id", "id"]).drop("id", "row_index").join(labels.drop("id"), ["table_id", "label"]).drop("label").distinct()
    values = deduplicated(data.where("col_index > 0").select("id", "table_id", "row_index", "col_index", "text_value"))
    return values.join(rows, ["table_id", "row_index"]).select(*known, "is_new", F.col("id").alias("cell_id"), "col_index", "text_value")


def _yearbook(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in ("annual_reports", "stat_tables", "stat_table_cells")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yearbook_changes(spark, *_yearbook(spark, sf_dir)).select("year", "code", "label_cell_id", "change_kind")


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports, tables, cells = _yearbook(spark, sf_dir)
    return changed_values(yearbook_changes(spark, reports, tables, cells), cells)
