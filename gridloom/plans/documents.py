"""Queries of the sources and of streaming: grids written as documents and read back, and windows over events."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.checks import GRID, order_grid
from gridloom.plans.registry import query
from gridloom.sources import ingest
from gridloom.session import cut, table
from gridloom.streaming.landing import event_rates

READ = GRID + f"""SELECT '1-1-' || t AS code, r AS row_index, c AS col_index, v AS numeric_value FROM g"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_id, rows: the dense texts of each grid in order; a grid has 7 rows."""
    c = cut(order_grid(spark, sf_dir))
    r = c.groupBy("table_id", "row_index").agg(F.array_sort(F.collect_list(F.struct("col_index", "text_value"))).alias("t"))
    return r.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_index", F.transform("t", lambda x: x["text_value"]).alias("t")))).alias("r")).select("table_id", F.transform("r", lambda x: x["t"]).alias("rows"))


def _html(rows: list[list[str]], code: str) -> bytes:
    body = "".join("<tr>" + "".join(f"<{'th' if i == 0 else 'td'}>{v}</{'th' if i == 0 else 'td'}>" for v in r) + "</tr>\n" for i, r in enumerate(rows))
    return f"# {code} 주문 현황 Orders\n(단위 : 건)\n<table>\n{body}</table>\n출처: 통계과\n".encode()


def _pipe(rows: list[list[str]], code: str) -> bytes:
    line = lambda r: "| " + " | ".join(v.replace("|", "\\|") for v in r) + " |"
    return "\n".join([f"## {code} 주문 현황 Orders", "(단위 : 건)", "", line(rows[0]), "|" + "---|" * len(rows[0]), *map(line, rows[1:]), "", "출처: 통계과"]).encode()


def xlsx(rows: list[list[str]], code: str) -> bytes:
    """A minimal workbook with inline texts: metadata rows, then a grid."""
    return sheet([["표번호", code], ["통계명", "주문 현황"], ["단위", "건"], ["기준일", "2025. 12. 31."], ["출처", "통계과"], [], *rows])


def sheet(rows: list[list[str]]) -> bytes:
    esc = lambda v: v.replace("&", "&amp;").replace("<", "&lt;")
    name = lambda j: (chr(64 + j // 26) if j >= 26 else "") + chr(65 + j % 26)
    body = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{name(j)}{i + 1}" t="inlineStr"><is><t>{esc(v)}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def hwpx(rows: list[list[str]], code: str) -> bytes:
    cell = lambda i, j, v: f'<tc><cellAddr rowAddr="{i}" colAddr="{j}"/><cellSpan rowSpan="1" colSpan="1"/><p><run charPrIDRef="0"><t>{v}</t></run></p></tc>'
    tbl = lambda m: "<tbl>" + "".join("<tr>" + "".join(cell(i, j, v) for j, v in enumerate(r)) + "</tr>" for i, r in enumerate(m)) + "</tbl>"
    body = f"<sec><p><run>{tbl([[f'{code} 주문 현황 Orders']])}</run></p><p><run><t>(단위 : 건)</t></run></p><p><run>{tbl(rows)}</run></p><p><run><t>출처: 통계과</t></run></p></sec>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Contents/header.xml", '<head><charPr id="0" textColor="#000000"/></head>')
        z.writestr("Contents/section0.xml", body)
    return out.getvalue()


def _written(spark: SparkSession, sf_dir: str, suffix: str, writer) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_pylist(), b.column(1).to_pylist()
            content = [writer(r, f"1-1-{i}") for i, r in zip(ids, rows)]
            yield pa.RecordBatch.from_arrays([pa.array([f"/mem/{i}.{suffix}" for i in ids]), pa.array(map(len, content), pa.int64()), pa.array(content, pa.binary())], names=["path", "length", "content"])

    files = _rows(spark, sf_dir).mapInArrow(kernel, "path string, length long, content binary").withColumn("file_hash", F.sha2("content", 256))
    cells = ingest.cells_of(ingest.parsed(ingest.acceptable(files).where("refused is null")))
    return cells.where("not is_header and col_index > 0").select("code", "row_index", "col_index", "numeric_value")


for _suffix, _writer in (("html", _html), ("md", _pipe), ("xlsx", xlsx), ("hwpx", hwpx)):
    query(f"src_{_suffix}", READ)(lambda spark, sf_dir, s=_suffix, w=_writer: _written(spark, sf_dir, s, w))


def _untidy(rows: list[list[str]], code: str) -> bytes:
    """A document whose table has a caption, notes, an empty column, headers printed again, a row given twice, and English labels in a column of their own."""
    wide = [[r[0] if i == 0 else f"국가{i}", "" if i == 0 else (r[0] if r[0].isascii() else "Total"), "", *r[1:]] for i, r in enumerate(rows)]
    width = len(wide[0])
    bare = lambda t: [t] + [""] * (width - 1)
    table_ = [bare("▫ 주문 Orders (단위 : 건)"), wide[0], wide[1], wide[2], bare("* 주 1) 잠정"), wide[0], wide[2], *wide[3:], bare("출처: 통계과")]
    body = "".join("<tr>" + "".join(f"<td>{v}</td>" for v in r) + "</tr>" for r in table_)
    return f"# {code} 현황 Status\n<table>{body}</table>\n".encode()


def _in_two(rows: list[list[str]], code: str) -> bytes:
    """A table that goes on in a second one under the same header, and in a third one without a header."""
    html = lambda m: "<table>" + "".join("<tr>" + "".join(f"<td>{v}</td>" for v in r) + "</tr>" for r in m) + "</table>\n"
    return (f"# {code} 현황 Status\n" + html(rows[:3]) + html([rows[0], *rows[3:5]]) + html(rows[5:])).encode()


for _name, _writer in (("untidy", _untidy), ("joined", _in_two)):
    query(f"src_{_name}", READ)(lambda spark, sf_dir, w=_writer: _written(spark, sf_dir, "html", w))


@query("src_sections", "SELECT '1-1-' || (n_regionkey + 1) AS code, '주문' AS section_title, 'Orders' AS section_title_en FROM nation GROUP BY n_regionkey")
def src_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that a document's outline puts each table under."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = ["# 주문 Orders\n\n#".encode() + _html(r, f"1-1-{i}") for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f"/mem/{k}.md" for k in range(len(content))]), pa.array(["x"] * len(content)), pa.array(content, pa.binary())], names=["path", "file_hash", "content"])

    return ingest.parsed(_rows(spark, sf_dir).mapInArrow(kernel, "path string, file_hash string, content binary")).select("code", "section_title", "section_title_en")


@query("src_marked", GRID + f"SELECT '1-1-' || t AS code, r AS row_index, c AS col_index, '검토 ' || r AS text FROM g WHERE c = 1")
def src_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts marked blue: one in the second column of every row; marked numbers, contacts and addresses beside them are passed over."""

    def document(rows: list[list[str]], code: str) -> bytes:
        run = lambda t, k: f'<run charPrIDRef="{k}"><t>{t}</t></run>'
        cell = lambda i, j, v: f'<tc><cellAddr rowAddr="{i}" colAddr="{j}"/><p>{run(v, 0)}{run(f"검토 {i}", 1) if i and j == 1 else run("1,234", 1) if i and j == 2 else ""}</p></tc>'
        table_ = "<tbl>" + "".join("<tr>" + "".join(cell(i, j, v) for j, v in enumerate(r)) + "</tr>" for i, r in enumerate(rows)) + "</tbl>"
        extra = "".join(f"<p>{run(t, 1)}</p>" for t in ("통계과 주무관 김일표 (044-205-2315)", "www.stat.example", "단위: 명"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("Contents/header.xml", '<head><charPr id="0" textColor="#000000"/><charPr id="1" textColor="#0000FF"/></head>')
            z.writestr("Contents/section0.xml", f"<sec><p>{run(code + ' 주문 현황', 0)}</p><p><run>{table_}</run></p>{extra}</sec>")
        return out.getvalue()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = [document(r, f"1-1-{i}") for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f"/mem/{k}.hwpx" for k in range(len(content))]), pa.array(content, pa.binary())], names=["path", "content"])

    return ingest.blue(_rows(spark, sf_dir).mapInArrow(kernel, "path string, content binary")).select("code", "row_index", "col_index", "text")


@query("src_owners", "SELECT year, row_number, title, department, department_raw FROM (SELECT year, CAST(row_number() OVER (PARTITION BY year ORDER BY owner_id) + 2 AS INT) AS row_number, title, coalesce(department, '') AS department, regexp_replace(trim(regexp_replace(coalesce(officer_raw, ''), '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')), '^ | $', '', 'g') AS department_raw FROM reference_owners) WHERE title <> '' AND (department <> '' OR department_raw <> '')".replace("\\\\", "\\"))
def src_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of owners, a workbook a year, written and read again."""
    o = table(spark, sf_dir, "reference_owners").select("year", "owner_id", F.array(F.lit("1"), *[F.coalesce(c, F.lit("")) for c in ("title", "department", "officer_raw")], F.lit("")).alias("r"))
    o = o.groupBy("year").agg(F.transform(F.array_sort(F.collect_list(F.struct("owner_id", "r"))), lambda x: x["r"]).alias("rows"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = [sheet([["담당"], ["연번", "통계명", "부서", "담당자", "비고"], *rows]) for rows in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([str(y) for y in b.column(0).to_pylist()]), pa.array(content, pa.binary())], names=["path", "content"])

    got = ingest.owners(o.mapInArrow(kernel, "path string, content binary"), start=2)
    return got.select(F.col("path").cast("int").alias("year"), "row_number", "title", "department", F.col("officer").alias("department_raw"))


@query("src_siblings", "SELECT id, regexp_replace(source_file_path, '[.]hwpx$', '.md') AS path, CASE WHEN id % 2 = 0 THEN source_file_path END AS source FROM annual_reports")
def src_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The originals of Markdown files, of which every second one is there."""
    r = table(spark, sf_dir, "annual_reports")
    paths = r.select("id", F.regexp_replace("source_file_path", r"[.]hwpx$", ".md").alias("path"))
    return ingest.siblings(paths, r.where("id % 2 = 0").select(F.col("source_file_path").alias("path")))


@query("src_years", "SELECT id, CAST(regexp_extract(source_file_name, '(20[0-9]{2})', 1) AS INT) AS year FROM annual_reports")
def src_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "annual_reports").select("id", ingest.year_of_name(F.col("source_file_path")).alias("year"))


@query("src_metadata", "SELECT DISTINCT '1-1-' || (n_regionkey + 1) AS code, '주문 현황' AS title, '건' AS unit, '2025. 12. 31.' AS base_date, '통계과' AS source FROM nation")
def src_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that a workbook's first rows give."""
    rows = _rows(spark, sf_dir).select(F.col("table_id"), "rows")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = [xlsx(r, f"1-1-{i}") for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f"/mem/{k}.xlsx" for k in range(len(content))]), pa.array(["x"] * len(content)), pa.array(content, pa.binary())], names=["path", "file_hash", "content"])

    return ingest.parsed(rows.mapInArrow(kernel, "path string, file_hash string, content binary")).select("code", "title", "unit", "base_date", "source")


@query("snk_copy_report", "SELECT (SELECT count(*) FROM annual_reports WHERE id = 8) AS reports, (SELECT count(*) FROM stat_tables WHERE report_id = 8) AS tables, (SELECT count(*) FROM stat_table_cells WHERE table_id IN (SELECT id FROM stat_tables WHERE report_id = 8)) AS cells")
def snk_copy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ingest.copy_report({n: table(spark, sf_dir, n) for n in ("annual_reports", "stat_tables", "stat_table_cells")}, 8)
    n = [t[k].agg(F.count("*").alias(a)) for k, a in (("annual_reports", "reports"), ("stat_tables", "tables"), ("stat_table_cells", "cells"))]
    one = [x.withColumn("k", F.lit(1)) for x in n]
    return one[0].join(one[1], "k").join(one[2], "k").drop("k")


@query("snk_metadata", r"SELECT report_id, regexp_replace(code, '\s+표\s*[0-9]+$', '') AS base, min(title) AS title, string_agg(DISTINCT unit, ' | ' ORDER BY unit) AS units FROM stat_tables GROUP BY ALL")
def snk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.operators.crosstable import base_code

    return table(spark, sf_dir, "stat_tables").groupBy("report_id", base_code(F.col("code")).alias("base")).agg(F.min("title").alias("title"), F.array_join(F.array_sort(F.collect_set("unit")), " | ").alias("units"))


@query("stream_event_rates", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed plan of the stream, over the whole table at once."""
    out = event_rates(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
