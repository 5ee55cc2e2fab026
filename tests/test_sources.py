"""Parsers on small documents, and a landing folder that is imported once."""

import io
import zipfile

from gridloom.plans.documents import hwpx, xlsx
from gridloom.sources import archive, ingest, markup
from gridloom.streaming.landing import watch


def test_html_spans():
    t = markup.parse_markup('# 1-1-1-2 인구 Population\n(단위 : 명, 2025. 12. 31. 기준)\n<table><tr><th rowspan="2">구분</th><th colspan="2">인원</th></tr><tr><th>남</th><th>여</th></tr><tr><td>계</td><td>1</td><td>2<br>(3%)</td></tr></table>\n출처: 통계과\n주) 잠정')[0]
    assert t.matrix == [["구분", "인원", ""], ["구분", "남", "여"], ["계", "1", "2\n(3%)"]]
    assert (t.code, t.title, t.title_en, t.unit, t.base_date, t.source, t.note, t.header_rows) == ("1-1-1-2", "인구", "Population", "명", "2025. 12. 31.", "통계과", "잠정", 2)


def test_pipes_and_parts():
    text = "## 1-2-3 가\n| a | b |\n|---|:-:|\n| x\\|y | 1 |\n\n## 1-2-3 가\n| a | b |\n|---|---|\n| z | 2 |"
    a, b = markup.parse_markup(text)
    assert a.matrix == [["a", "b"], ["x|y", "1"]] and [a.code, b.code] == ["1-2-3", "1-2-3 표2"]
    assert markup.parse_markup("") == [] == markup.parse_markup("no | table here")


def test_workbook():
    t = archive.parse_xlsx(xlsx([["구분", "합계", "남"], ["계", "3", "1"]], "1-1-1-1"))[0]
    assert (t.code, t.title, t.unit, t.base_date, t.source) == ("1-1-1-1", "주문 현황", "건", "2025. 12. 31.", "통계과")
    assert t.matrix == [["구분", "합계", "남"], ["계", "3", "1"]] and t.header_rows == 1
    assert archive.shown("0.125", "n", "0.0%") == "12.5%" and archive.shown("1234", "n", "#,##0") == "1,234" and archive.shown("45000", "n", "date") == "2023. 03. 15." and archive.shown("1", "b", "") == "TRUE"


def _doc(body, head=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Contents/header.xml", f"<h>{head}</h>")
        z.writestr("Contents/section0.xml", f"<s>{body}</s>")
    return out.getvalue()


def test_document_parts_and_marks():
    t = archive.parse_hwpx(hwpx([["구분", "a"], ["x", "1"], ["y", "2"]], "1-1-2"))[0]
    assert (t.code, t.title, t.title_en, t.unit, t.source) == ("1-1-2", "주문 현황", "Orders", "건", "통계과") and t.matrix[2] == ["y", "2"]
    doc = _doc('<p><run charPrIDRef="1"><t>2-1-1 표</t></run></p><p><run charPrIDRef="9"><t>고칠 말</t></run><run charPrIDRef="1"><t>그냥</t></run></p><p><run charPrIDRef="9"><t>12.5</t></run></p>', '<charPr id="9" textColor="#0000FF"/><charPr id="1" textColor="#000000"/>')
    assert archive.blue_texts(doc) == [("2-1-1", "고칠 말")]


def test_landing_is_idempotent(spark, tmp_path):
    inbox, store, mark = tmp_path / "in", tmp_path / "store", tmp_path / "mark"
    inbox.mkdir()
    book = xlsx([["구분", "합계"], ["계", "3"]], "1-1-1-1")
    (inbox / "a.xlsx").write_bytes(book)
    (inbox / "b.xlsx").write_bytes(book)  # the same content
    (inbox / "broken.xlsx").write_bytes(b"not a workbook")
    (inbox / "empty.md").write_bytes(b"")
    for _ in range(2):
        watch(spark, str(inbox), str(store), str(mark)).awaitTermination()
    tables = spark.read.parquet(f"{store}/tables")
    assert tables.where("matrix is not null").count() == 1 and tables.where("error is not null").count() == 1
    assert spark.read.parquet(f"{store}/cells").count() == 4
    (inbox / "c.xlsx").write_bytes(book)
    (inbox / "d.md").write_bytes("# 1-2-3 가\n| a | b |\n|---|---|\n| z | 2 |".encode())
    watch(spark, str(inbox), str(store), str(mark)).awaitTermination()
    assert spark.read.parquet(f"{store}/reports").count() == 3 and spark.read.parquet(f"{store}/cells").count() == 8


def test_refusals(spark):
    df = spark.createDataFrame([("a.xlsx", 0), ("b.exe", 5), ("c.md", 200_000_000), ("d.html", 3)], "path string, length long")
    assert [r.refused for r in ingest.acceptable(df).collect()] == ["empty", "unsupported kind", "too large", None]
