"""Tables of zipped XML documents: spreadsheets (.xlsx) and word-processor documents (.hwpx), by the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

from gridloom.sources.markup import CODE, Parsed, header_rows, label_key, numbered, squeeze, take_metadata, title_parts, trimmed, unit_and_date

# Built-in number formats of spreadsheets that show dates, thousands or percentages.
DATE_FORMATS = {14, 15, 16, 17, 22}
BUILT_IN = {3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 37: "#,##0", 38: "#,##0", 39: "#,##0.00", 40: "#,##0.00"}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if _local(x.tag) == name]


def _text(e: ET.Element) -> str:
    return squeeze("".join(e.itertext()))


def shown(value: str, kind: str, code: str) -> str:
    """How a spreadsheet shows a stored value under a number format."""
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if kind in ("s", "str", "inlineStr", "e"):
        return squeeze(value)
    if not value:
        return ""
    x = float(value)
    if code == "date":
        return (datetime(1899, 12, 30) + timedelta(days=x)).strftime("%Y. %m. %d.")
    if "%" in code:
        digits = re.search(r"\.(0+)\s*%", code)
        return f"{x * 100:.{len(digits[1]) if digits else 0}f}%"
    if x.is_integer():
        return f"{int(x):,}" if "," in code else str(int(x))
    return value if re.fullmatch(r"-?\d+\.\d+", value) else str(x)


def _cell_at(ref: str) -> tuple[int, int]:
    m = re.match(r"([A-Z]+)(\d+)", ref)
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, matrix) of all sheets; a merged range shows its first cell everywhere."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    strings = [_text_of_string(x) for x in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    formats: list[str] = []
    if "xl/styles.xml" in names:
        root = ET.fromstring(z.read("xl/styles.xml"))
        own = {int(x.get("numFmtId")): x.get("formatCode") for x in _children(root, "numFmt")}
        for xfs in (x for x in root if _local(x.tag) == "cellXfs"):
            for x in xfs:
                n = int(x.get("numFmtId") or 0)
                code = own.get(n, BUILT_IN.get(n, ""))
                bare = re.sub(r'"[^"]*"|\[[^\]]*\]', "", code)
                formats.append("date" if n in DATE_FORMATS or re.search(r"[yd]", bare, re.I) and "%" not in bare else code)
    book = ET.fromstring(z.read("xl/workbook.xml"))
    targets = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in _children(book, "sheet"):
        target = targets[next(v for k, v in s.attrib.items() if _local(k) == "id")].lstrip("/")
        root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        grid: dict[tuple[int, int], str] = {}
        for c in _children(root, "c"):
            kind, style = c.get("t") or "n", int(c.get("s") or 0)
            v = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
            if kind == "s":
                v = strings[int(v)]
            elif kind == "inlineStr":
                v = "".join(c.itertext())
            grid[_cell_at(c.get("r"))] = shown(v, kind, formats[style] if style < len(formats) else "")
        for m in _children(root, "mergeCell"):
            (a, b), (c, d) = map(_cell_at, m.get("ref").split(":"))
            for i in range(a, c + 1):
                for j in range(b, d + 1):
                    grid[i, j] = grid.get((a, b), "")
        n, w = max((i for i, _ in grid), default=-1) + 1, max((j for _, j in grid), default=-1) + 1
        out.append((s.get("name") or "", [[grid.get((i, j), "") for j in range(w)] for i in range(n)]))
    return out


def _text_of_string(e: ET.Element) -> str:
    return "".join(x.text or "" for x in _children(e, "t"))


def parse_xlsx(data: bytes, name: str = "") -> list[Parsed]:
    """All tables of a workbook: a row whose first four cells hold a table code starts one."""
    out: list[Parsed] = []
    for sheet, matrix in sheets(data):
        starts = [i for i, r in enumerate(matrix) if CODE.search(" ".join(r[:4]))] or [0]
        starts[0] = 0 if len(starts) == 1 else starts[0]
        for start, end in zip(starts, [*starts[1:], len(matrix)]):
            section = matrix[start:end]
            p = Parsed(section_file=sheet, table_order=len(out))
            rows = take_metadata(p, section)
            context = "\n".join(" ".join(r) for r in section)
            unit, date = unit_and_date(context)
            p.unit, p.base_date = p.unit or unit, p.base_date or date
            if not p.code:
                m = CODE.search(context) or CODE.search(sheet)
                p.code = squeeze(m[0]) if m else sheet.strip() or f"excel-{len(out) + 1}"
            if not p.title:
                line = next((" ".join(v for v in dict.fromkeys(r) if v) for r in rows if p.code in " ".join(r)), sheet)
                _, p.title, p.title_en = title_parts(line)
            data_at = next((i for i, r in enumerate(rows) if sum(map(bool, r)) >= 2 and p.code not in " ".join(r) and not label_key(next(v for v in r if v))), len(rows))
            p.matrix = trimmed(rows[data_at:])
            if p.matrix and len(p.matrix[0]) >= 2:
                p.header_rows = header_rows(p.matrix)
                out.append(p)
    return numbered(out)


def _cell_runs(cell: ET.Element, raised: set[str]) -> tuple[str, str]:
    """(text, footnote markers) of a cell, its runs read once: a raised run of one or more `N)` is markers, any other is text."""
    text, marks = [], {}
    for run in _children(cell, "run"):
        said = "".join(run.itertext())
        numbers = re.findall(r"\d+\)", said) if run.get("charPrIDRef") in raised else []
        if numbers and not re.sub(r"\d+\)|\s", "", said):
            marks |= dict.fromkeys(numbers)
        else:
            text.append(said)
    return squeeze("".join(text)), " ".join(marks)


def _hwpx_table(table: ET.Element, raised: set[str]) -> tuple[list[list[str]], list[list[str]]]:
    """(texts, footnote markers): a cell over rows repeats downwards, one over columns fills the first."""
    texts: dict[tuple[int, int], str] = {}
    marks: dict[tuple[int, int], str] = {}
    n = m = 0
    for tr in (x for x in table if _local(x.tag) == "tr"):
        for tc in (x for x in tr if _local(x.tag) == "tc"):
            addr = next((x for x in tc if _local(x.tag) == "cellAddr"), None)
            span = next((x for x in tc if _local(x.tag) == "cellSpan"), None)
            i, j = int(addr.get("rowAddr") or 0), int(addr.get("colAddr") or 0)
            down, across = (int(span.get("rowSpan") or 1), int(span.get("colSpan") or 1)) if span is not None else (1, 1)
            text, found = _cell_runs(tc, raised)
            for a in range(down):
                texts.setdefault((i + a, j), text)
                marks.setdefault((i + a, j), found)
            n, m = max(n, i + down), max(m, j + across)
    full = lambda d: [[d.get((i, j), "") for j in range(m)] for i in range(n)]
    return full(texts), full(marks)


def _char_ids(z: zipfile.ZipFile, test) -> set[str]:
    if "Contents/header.xml" not in z.namelist():
        return set()
    return {x.get("id") for x in _children(ET.fromstring(z.read("Contents/header.xml")), "charPr") if x.get("id") and test(x)}


def parse_hwpx(data: bytes, name: str = "", number: bool = True) -> list[Parsed]:
    """All tables of a document: a small table with a code is a title, the data tables after it are its parts, paragraphs give sources and notes."""
    z = zipfile.ZipFile(io.BytesIO(data))
    raised = _char_ids(z, lambda x: any(_local(c.tag) == "supscript" for c in x))
    out: list[Parsed] = []
    title, context = ("", "", ""), ""
    for section in sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
        inside: set[int] = set()
        for e in ET.fromstring(z.read(section)).iter():
            if id(e) in inside:
                continue
            if _local(e.tag) == "tbl":
                inside.update(id(x) for x in e.iter())
                matrix, marks = _hwpx_table(e, raised)
                text = _text(e)
                full = sum(bool(v) for r in matrix for v in r)
                if CODE.search(text) and (len(matrix) <= 2 or max(map(len, matrix), default=0) <= 2):
                    title, context = title_parts(text), ""
                elif len(matrix) >= 3 and max(map(len, matrix)) >= 2 and full >= 6 and title[0]:
                    p = Parsed(*title, section_file=section, table_order=len(out))
                    p.unit, p.base_date = unit_and_date(context)
                    kept = [i for i, r in enumerate(matrix) if any(r)]
                    p.matrix, p.footnotes = [matrix[i] for i in kept], [marks[i] for i in kept]
                    p.header_rows = header_rows(p.matrix)
                    out.append(p)
            elif _local(e.tag) == "p" and not _children(e, "tbl"):
                inside.update(id(x) for x in e.iter())
                text = _text(e)
                if m := re.match(r"(?:출처|자료)\s*[:：]\s*(.+)", text):
                    if out:
                        out[-1].source = "\n".join(x for x in (out[-1].source, m[1]) if x)
                elif m := re.match(r"(?:주\s*\d*\s*[):：]|\d+\))\s*(.+)", text):
                    if out:
                        out[-1].note = "\n".join(x for x in (out[-1].note, text) if x)
                else:
                    context += "\n" + text
    return numbered(out) if number else out


#: Marked texts that nobody need review: numbers, addresses, contacts, metadata lines, and what is too long for one text.
PASSED_OVER = re.compile(r"[\d,.%\s()-]+|.*://.*|.*\bwww\..*|.*0\d{1,2}[-)]?\s*\d{3,4}-\d{4}.*|(?:단위|기준일|기준|출처|자료|unit|source)\s*[:：].*", re.I | re.DOTALL)
LONGEST = 1400


@dataclass(frozen=True)
class Marked:
    """A text that reviewers marked: where it stands, and what stands around it. row and col are -1 outside of tables."""

    code: str
    text: str
    row: int = -1
    col: int = -1
    cell_text: str = ""
    row_text: str = ""


def marked_texts(data: bytes, colour: str = "#0000ff") -> list[Marked]:
    """Every paragraph's text in the given colour, in order, with the cell and row that hold it."""
    z = zipfile.ZipFile(io.BytesIO(data))
    ids = _char_ids(z, lambda x: (x.get("textColor") or "").lower() == colour)
    out, code = [], ""
    for section in sorted((n for n in z.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
        root = ET.fromstring(z.read(section))
        around: dict[int, tuple[int, int, str, str]] = {}
        for tr in _children(root, "tr"):
            cells = [tc for tc in tr if _local(tc.tag) == "tc"]
            line = " | ".join(_text(tc) for tc in cells)
            for tc in cells:
                addr = next((x for x in tc if _local(x.tag) == "cellAddr"), None)
                at = (int(addr.get("rowAddr") or 0), int(addr.get("colAddr") or 0)) if addr is not None else (-1, -1)
                around |= {id(p): (*at, _text(tc), line) for p in _children(tc, "p")}  # an inner table's own cells come later
        for p in _children(root, "p"):
            if m := CODE.search(_text(p)):
                code = squeeze(m[0])
            runs = [r for r in p if _local(r.tag) == "run" and r.get("charPrIDRef") in ids and not _children(r, "tbl")]
            text = squeeze("".join("".join(r.itertext()) for r in runs))
            if text and len(text) <= LONGEST and not PASSED_OVER.fullmatch(text):
                out.append(Marked(code, text, *around.get(id(p), (-1, -1, "", ""))))
    return out


def blue_texts(data: bytes) -> list[tuple[str, str]]:
    """(table code, text) of what reviewers marked in pure blue, in order."""
    return [(m.code, m.text) for m in marked_texts(data)]
