"""Files to tables and cells: binary scan, parsers by suffix, idempotence by content hash, sinks that can be repeated."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import numeric as N
from gridloom.operators.relational import insert_ignore, latest
from gridloom.sources.archive import marked_texts, parse_hwpx, parse_xlsx, sheets
from gridloom.sources.markup import numbered, parse_markup
from gridloom.sources.shape import owner_rows, tidied


def _text(data: bytes, name: str) -> list:
    return numbered(tidied(parse_markup(data.decode("utf-8", "replace"), name, number=False)))


#: Suffix -> parser of (content, name).
PARSERS = {"xlsx": parse_xlsx, "hwpx": lambda data, name: numbered(tidied(parse_hwpx(data, name, number=False))), "md": _text, "html": _text}
MOST_BYTES = 104_857_600
FIELDS = ("code", "title", "title_en", "unit", "base_date", "source", "note", "domain", "section_title", "section_title_en", "section_file")
PARSED = "path string, file_hash string, error string, " + ", ".join(f"{f} string" for f in FIELDS) + ", table_order int, header_rows int, matrix array<array<string>>, footnotes array<array<string>>"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, file_hash of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content", F.sha2("content", 256).alias("file_hash"))


def acceptable(files: DataFrame) -> DataFrame:
    """files with the reason why one isn't accepted (null if it is): empty, too large, or of another kind."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return files.withColumn("refused", F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too large").when(~suffix.isin(*PARSERS), "unsupported kind"))


def parsed(files: DataFrame) -> DataFrame:
    """One row per table of every file; a file that can't be parsed gives one row with its error and no matrix."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in PARSED.split(", ")]
        text, cells = pa.string(), pa.list_(pa.list_(pa.string()))
        schema = pa.schema([(n, pa.int32() if n in ("table_order", "header_rows") else cells if n in ("matrix", "footnotes") else text) for n in names])
        for b in batches:
            for path, digest, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    tables = PARSERS[path.rpartition(".")[2].lower()](content or b"", path.rpartition("/")[2])
                    rows = [{"path": path, "file_hash": digest, "error": None, **vars(t)} for t in tables]
                except Exception as e:  # noqa: BLE001 - a broken file must not end the job
                    rows = [{n: None for n in names} | {"path": path, "file_hash": digest, "error": f"{type(e).__name__}: {e}"[:300]}]
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)

    return files.select("path", "file_hash", "content").mapInArrow(kernel, PARSED)


def cells_of(tables: DataFrame) -> DataFrame:
    """file_hash, code, row_index, col_index, text_value, numeric_value, is_header, footnote_marker."""
    t = tables.where("matrix is not null").select("file_hash", "code", "header_rows", "footnotes", F.posexplode("matrix").alias("row_index", "texts"))
    c = t.select("file_hash", "code", "header_rows", "row_index", F.try_element_at("footnotes", F.col("row_index") + 1).alias("marks"), F.posexplode("texts").alias("col_index", "text_value"))
    header = F.col("row_index") < F.col("header_rows")
    mark = F.nullif(F.try_element_at("marks", F.col("col_index") + 1), F.lit(""))
    return c.select("file_hash", "code", "row_index", "col_index", "text_value", F.when(~header, N.parse_number(F.col("text_value"))).alias("numeric_value"), header.alias("is_header"), mark.alias("footnote_marker"))


def owners(files: DataFrame, start: int = 3) -> DataFrame:
    """path, sheet, row_number, number, title, department, officer, note of the lists of owners in workbooks."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row_number", pa.int32()), *((k, pa.string()) for k in ("number", "title", "department", "officer", "note"))])
        for b in batches:
            rows = [{"path": p, "sheet": sheet, **r} for p, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for sheet, m in sheets(d) for r in owner_rows(m, start)]
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.select("path", "content").mapInArrow(kernel, "path string, sheet string, row_number int, number string, title string, department string, officer string, note string")


def siblings(paths: DataFrame, files: DataFrame, suffix: str = "hwpx") -> DataFrame:
    """paths (path) with `source`: the file of the same folder and stem with the suffix, null if there is none."""
    stem = F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "")
    f = files.where(F.lower("path").endswith(f".{suffix}")).select(stem.alias("__stem"), F.col("path").alias("source")).groupBy("__stem").agg(F.min("source").alias("source"))
    return paths.withColumn("__stem", stem).join(f, "__stem", "left").drop("__stem")


def jdbc_options(url: str, source: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 16, rows: int = 10_000) -> dict[str, str]:
    """Options of a parallel read of a database table: ranges of a numeric key, one a partition; the database's dialect is Spark's affair."""
    out = {"url": url, "dbtable": source, "fetchsize": str(rows)}
    if key is not None:
        out |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(max(high, low + 1)), "numPartitions": str(parts)}
    return out


def from_database(spark: SparkSession, url: str, source: str, **more) -> DataFrame:
    """A table or bracketed query of a database; its driver must be on the class path."""
    return spark.read.format("jdbc").options(**jdbc_options(url, source, **more)).load()


def year_of_name(path: Column) -> Column:
    """The year in a file's name, or null."""
    return F.nullif(F.regexp_extract(F.substring_index(path, "/", -1), r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit("")).cast("int")


def store_profiles(profiles: DataFrame, path: str, turn: int) -> None:
    """Appends the profiles of one turn; a turn that is written again replaces itself."""
    profiles.withColumn("turn", F.lit(turn)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("turn").parquet(path)


def stored_profiles(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The latest profile of each key."""
    return latest(spark.read.parquet(path), key, ["turn"])


def blue(files: DataFrame) -> DataFrame:
    """path, pos, code, text, row_index, col_index (null outside of tables), cell_text, row_text of the texts marked blue in word-processor documents."""
    kinds = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("code", pa.string()), ("text", pa.string()), ("row_index", pa.int32()), ("col_index", pa.int32()), ("cell_text", pa.string()), ("row_text", pa.string())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, m in enumerate(marked_texts(data)):
                    inside = m.row >= 0
                    rows.append({"path": path, "pos": i, "code": m.code, "text": m.text, "row_index": m.row if inside else None, "col_index": m.col if inside else None, "cell_text": m.cell_text, "row_text": m.row_text})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    out = "path string, pos int, code string, text string, row_index int, col_index int, cell_text string, row_text string"
    return files.where(F.lower("path").endswith(".hwpx")).select("path", "content").mapInArrow(kernel, out)


def land(spark: SparkSession, files: DataFrame, store: str, batch: str) -> None:
    """Imports the files whose content isn't in the store yet: reports, tables and cells of one batch.

    Every write replaces the batch's own partition, so that a batch that is run again leaves the same store.
    """
    ok = acceptable(files).where("refused is null").dropDuplicates(["file_hash"])
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/reports")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        ok = insert_ignore(spark.read.parquet(f"{store}/reports").where(F.col("batch") != batch).select("file_hash"), ok, ["file_hash"])
    tables = parsed(ok)

    def put(df: DataFrame, name: str) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/{name}")

    put(tables, "tables")
    stored = spark.read.parquet(f"{store}/tables").where(F.col("batch") == batch)  # parsed once, read from the store
    put(cells_of(stored).drop("batch"), "cells")
    put(ok.select("path", "file_hash", "length"), "reports")


def export_csv(df: DataFrame, path: str, order: list[str]) -> int:
    """Writes df as CSV ordered by range (no single task holds all) and returns the rows read back."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path).count()


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def copy_report(tables: dict[str, DataFrame], report_id: int) -> dict[str, DataFrame]:
    """The closure of one report: its reports, stat_tables and cells rows."""
    r = tables["annual_reports"].where(F.col("id") == report_id)
    t = tables["stat_tables"].where(F.col("report_id") == report_id)
    c = tables["stat_table_cells"].join(t.select(F.col("id").alias("table_id")), "table_id", "left_semi")
    return {"annual_reports": r, "stat_tables": t, "stat_table_cells": c}


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


#: Encodings that Spark's own reader takes.
NATIVE = ("ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "UTF-8")


def lookup_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """A lookup file with a header, by column names; files in another encoding than NATIVE are decoded whole, one in a task, a byte that isn't in it as a mark."""
    if encoding.upper() in NATIVE:
        return spark.read.option("header", True).option("encoding", encoding).schema(schema).csv(path)
    kinds = spark.createDataFrame([], schema).schema
    names = kinds.names

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = list(csv.DictReader(io.StringIO(content.decode(encoding, "replace"), newline="")))
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], pa.string()) for n in names], names=names)

    out = spark.read.format("binaryFile").load(path).select("content").mapInArrow(kernel, ", ".join(f"`{n}` string" for n in names))
    return out.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in kinds])



