"""What imported tables are brought to: captions and notes taken out of the grid, repeats dropped, parts joined or split, label columns merged."""

from __future__ import annotations

import re
from dataclasses import replace

from gridloom.sources.markup import NUMERIC, Parsed, header_rows, squeeze, title_parts

NOTE = re.compile(r"^(?:#|\*\s*주|※|주\s*\d*\s*[):：])")
SOURCE = re.compile(r"^(?:출처|자료)\s*[:：]\s*")
#: Least pairs, rows with numbers and share of English texts by which a second column is the first one's English.
PAIRS, ROWS, ENGLISH = 3, 3, 0.7


def _number(v: str) -> bool:
    """Whether a text is a number and no year."""
    return bool(v and NUMERIC.match(v) and not re.fullmatch(r"(?:19|20)\d\d", v))


def without_empty_columns(matrix: list[list[str]]) -> list[list[str]]:
    width = max(map(len, matrix), default=0)
    keep = [j for j in range(width) if any(j < len(r) and r[j] for r in matrix)]
    return [[r[j] if j < len(r) else "" for j in keep] for r in matrix]


def take_captions(p: Parsed) -> Parsed:
    """A first row `▫ ...` names the part; rows of one cell that are a note or a source go to the table's note and source."""
    rows, note, source = [], [p.note] if p.note else [], [p.source] if p.source else []
    title, title_en = p.title, p.title_en
    for i, r in enumerate(p.matrix):
        said = [v for v in r if v]
        if i == 0 and said and said[0].startswith("▫"):
            caption = re.sub(r"\(\s*단위.*$", "", said[0].lstrip("▫ ")).strip()
            _, ko, en = title_parts(caption)
            title, title_en = ko or title, en or title_en
        elif len(said) == 1 and SOURCE.match(said[0]):
            source.append(SOURCE.sub("", said[0]))
        elif len(said) == 1 and NOTE.match(said[0]):
            note.append(said[0])
        else:
            rows.append(r)
    return replace(p, matrix=rows, title=title, title_en=title_en, note="\n".join(dict.fromkeys(note)), source="\n".join(dict.fromkeys(source)))


def without_repeats(matrix: list[list[str]]) -> list[list[str]]:
    """Without blank rows and, once a row with numbers has come, without rows seen before: headers printed again, data rows given twice."""
    out, seen, data = [], set(), False
    for r in matrix:
        if not any(r) or data and tuple(r) in seen:
            continue
        data = data or any(map(_number, r[1:]))
        seen.add(tuple(r))
        out.append(r)
    return out


def merged_labels(matrix: list[list[str]]) -> list[list[str]]:
    """The second column put under the first, where it is the English of its labels and has no header of its own."""
    if len(matrix) < 4 or max(map(len, matrix)) < 4 or not matrix[0][0] or matrix[0][1]:
        return matrix
    body = [r for r in matrix[1:] if r[1]]
    english = [r for r in body if re.search("[A-Za-z]", r[1]) and not re.search("[가-힣]", r[1])]
    numbers = sum(any(map(_number, r[2:])) for r in matrix[1:])
    if len([r for r in english if r[0]]) < PAIRS or numbers < ROWS or len(english) < ENGLISH * len(body):
        return matrix
    return [["\n".join(v for v in r[:2] if v), *r[2:]] for r in matrix]


def _signature(p: Parsed) -> tuple[int, tuple[tuple[str, ...], ...] | None]:
    """(columns, header texts without counts and blanks; None if the first row is data already)."""
    head = [r for r in p.matrix[: p.header_rows]]
    if not head or any(map(_number, p.matrix[0][1:])):
        return max(map(len, p.matrix), default=0), None
    key = lambda v: re.sub(r"\(\s*\d[\d.,]*\s*[가-힣A-Za-z%]*\s*\)|\s", "", v).lower()
    return max(map(len, p.matrix)), tuple(tuple(map(key, r)) for r in head)


def joined(tables: list[Parsed]) -> list[Parsed]:
    """Tables of one code that follow each other: those that go on with the same header, or without one and as wide, are one; others are parts of their own."""
    out: list[Parsed] = []
    for t in tables:
        if out and t.code == out[-1].code and t.matrix:
            a, b = _signature(out[-1]), _signature(t)
            if a == b or b[1] is None and a[0] == b[0]:
                rest = t.matrix[t.header_rows :] if b[1] is not None else t.matrix
                marks = t.footnotes[t.header_rows :] if b[1] is not None else t.footnotes
                note = "\n".join(dict.fromkeys(x for x in (out[-1].note, t.note) if x))
                source = "\n".join(dict.fromkeys(x for x in (out[-1].source, t.source) if x))
                out[-1] = replace(out[-1], matrix=out[-1].matrix + rest, footnotes=out[-1].footnotes + marks, note=note, source=source)
                continue
        out.append(t)
    return out


def tidied(tables: list[Parsed]) -> list[Parsed]:
    """Every table with its captions taken out, repeats and empty columns dropped and label columns merged; then parts joined. Footnote marks keep their rows only if no row or column went."""
    out = []
    for t in tables:
        p = take_captions(t)
        matrix = merged_labels(without_empty_columns(without_repeats(p.matrix)))
        if len(matrix) < 2 or len(matrix[0]) < 2:
            continue
        same = matrix == t.matrix
        out.append(replace(p, matrix=matrix, header_rows=t.header_rows if same else header_rows(matrix), footnotes=t.footnotes if same else []))
    return joined(out)


def owner_rows(matrix: list[list[str]], start: int, first: int = 0) -> list[dict[str, str | int]]:
    """Rows of a list of owners from row `start` on: number, title, department, officer and note in five columns from `first`; rows without a title, or with neither department nor officer, aren't any."""
    out: list[dict[str, str | int]] = []
    for i, r in enumerate(matrix[start:], start + 1):
        no, title, department, officer, note = ([squeeze(v) for v in r[first : first + 5]] + [""] * 5)[:5]
        if title and (department or officer):
            out.append({"row_number": i, "number": no, "title": title, "department": department, "officer": officer, "note": note})
    return out
