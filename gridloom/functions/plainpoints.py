"""Plain form of whole text columns: the rules of `plainform` as table gathers over code-point arrays.

The text column of an Arrow batch becomes one numpy array of code points (one decoding of the whole value buffer), a
lookup table tells which rows hold anything to do, and only those rows go on: table gathers with expansion offsets
replace, expand and take out characters, marks are put in canonical order by one stable sort, and marks and Hangul
letters are composed in rounds over the whole array. No call is made per row or per string.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridloom.functions.plainform import INVISIBLE_RANGES, LATIN_MARKS, LOOK_ALIKES, MIXED_TEXT, replacements

#: Bytes of text handled at once; a longer text is a piece of its own.
CHUNK = 2_000_000
TOP = 0x30000
#: Entries of the lookup tables behind those of the code points: ideographs beyond TOP, invisible characters, all else.
FAR, HIDDEN, OTHER = TOP, TOP + 1, TOP + 2
SIZE = TOP + 3
L, V, TT, S = 0x1100, 0x1161, 0x11A7, 0xAC00


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    """Lookup tables by code point; three more entries stand for all beyond TOP (see entries)."""
    rep = replacements()
    outs: list[str] = []
    index = np.zeros(SIZE, np.int32)  # 0: itself
    touched = np.zeros(SIZE, bool)
    combining = np.zeros(SIZE, np.uint8)
    for c in range(0x80, TOP):
        if 0xD800 <= c < 0xE000 or 0xAC00 <= c < 0xD7A4 or 0x4E00 <= c < 0xA000 or 0x20000 <= c < 0x2F800:
            continue
        ch = chr(c)
        combining[c] = unicodedata.combining(ch)
        text = rep.get(c, ch)
        full = unicodedata.normalize("NFD", text) if text else ""
        if full != ch:
            outs.append(full)
            index[c] = len(outs)
        touched[c] = c in rep or combining[c] > 0 or unicodedata.normalize("NFC", ch) != ch or 0x1100 <= c < 0x1200
    for c in range(0x80):
        if c in rep:
            outs.append(rep[c])
            index[c], touched[c] = len(outs), True
    for c in {ord(x) for s in [*LOOK_ALIKES.values(), *LATIN_MARKS.values()] for x in s}:
        touched[c] = True
    outs.append("")
    index[HIDDEN], touched[HIDDEN] = len(outs), True
    lens = np.array([1] + [len(x) for x in outs], np.int32)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int32)
    chars = np.frombuffer(("\0" + "".join(outs)).encode("utf-32-le"), np.uint32).astype(np.int32)
    pairs, comp = [], []
    for c in range(0x80, TOP):
        d = unicodedata.decomposition(chr(c))
        if d and d[0] != "<" and " " in d:
            a, b = (int(x, 16) for x in d.split())
            if unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(c):
                pairs.append(a << 21 | b)
                comp.append(c)
    order = np.argsort(pairs)
    look = np.zeros(SIZE, np.int32)
    for to, signs in LOOK_ALIKES.items():
        for x in signs:
            look[ord(x)] = ord(to)
    marks = np.zeros(SIZE, np.int32)
    for to, signs in LATIN_MARKS.items():
        for x in signs:
            marks[ord(x)] = ord(to)
    latin, word = np.zeros(SIZE, bool), np.zeros(SIZE, bool)
    for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)):
        latin[a : b + 1] = True
    word |= latin
    for a, b in ((0x300, 0x36F), (0x370, 0x3FF), (0x400, 0x52F), (0x1F00, 0x1FFF)):
        word[a : b + 1] = True
    mixed = np.zeros(SIZE, bool)
    for a, b in MIXED_TEXT:
        mixed[a : min(b, FAR) + 1] = True
    return {"index": index, "touched": touched, "ccc": combining, "lens": lens, "starts": starts, "chars": chars, "pairs": np.array(pairs, np.int64)[order], "comp": np.array(comp, np.int32)[order], "look": look, "marks": marks, "latin": latin, "word": word, "mixed": mixed}


def entries(points: np.ndarray) -> np.ndarray:
    """The entry of the lookup tables for each code point."""
    out = np.minimum(points, OTHER)
    far = np.flatnonzero(points >= TOP)
    if len(far):
        x = points[far]
        hidden = np.zeros(len(x), bool)
        for a, b in INVISIBLE_RANGES:
            hidden |= (x >= a) & (x <= b)
        out[far] = np.where(hidden, HIDDEN, np.where(x < 0x40000, FAR, OTHER))
    return out


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows one after another, and each row's offsets (n + 1); null rows are empty."""
    column = column.cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(column.buffers()[2] or b"")[offs[0] : offs[-1]]
    points = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int32)
    # A row's first character is where the count of UTF-8 leading bytes up to its offset says.
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]) if len(raw) else np.zeros(1, np.int64)
    return points, lead[offs - offs[0]].astype(np.int64)


def texts(points: np.ndarray, offs: np.ndarray, null: np.ndarray) -> pa.Array:
    """The inverse of code_points."""
    raw = points.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(width)])[offs]
    mask = pa.array(~null).buffers()[1]
    return pa.Array.from_buffers(pa.large_string(), len(null), [mask, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])


def _compose(p: np.ndarray, row: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of decomposed code points; a row's text never mixes with the next."""
    at = lambda a: t["ccc"][entries(a)]
    ccc = at(p)
    if ccc.any():  # canonical order: a stable sort by (run of marks, class)
        run = np.cumsum((ccc == 0) | np.concatenate([[True], row[1:] != row[:-1]]))
        order = np.lexsort((ccc, run))
        p, row, ccc = p[order], row[order], ccc[order]
    # Hangul: leading + vowel, then syllable + trailing, each pair adjacent in the same row.
    same = np.concatenate([row[1:] == row[:-1], [False]])
    nxt = np.concatenate([p[1:], [0]]).astype(np.int32)
    lv = same & (p >= L) & (p < L + 19) & (nxt >= V) & (nxt < V + 21)
    if lv.any():
        i = np.flatnonzero(lv)
        p = p.copy()
        p[i] = S + ((p[i] - L) * 21 + (p[i + 1] - V)) * 28
        keep = np.ones(len(p), bool)
        keep[i + 1] = False
        p, row, ccc = p[keep], row[keep], ccc[keep]
    same = np.concatenate([row[1:] == row[:-1], [False]])
    nxt = np.concatenate([p[1:], [0]]).astype(np.int32)
    lvt = same & (p >= S) & (p < 0xD7A4) & ((p - S) % 28 == 0) & (nxt > TT) & (nxt < TT + 28)
    if lvt.any():
        i = np.flatnonzero(lvt)
        p = p.copy()
        p[i] += p[i + 1] - TT
        keep = np.ones(len(p), bool)
        keep[i + 1] = False
        p, row, ccc = p[keep], row[keep], ccc[keep]
    # Marks: in each round every starter takes its first mark that composes and isn't blocked.
    seen = np.zeros(len(p), bool)  # marks tried with the present form of their starter
    while len(p):
        idx = np.arange(len(p))
        starter = np.maximum.accumulate(np.where(ccc == 0, idx, -1))
        before = np.concatenate([[-1], starter[:-1]])
        cand = np.where(ccc == 0, np.where(before == idx - 1, before, -1), starter)
        ok = (cand >= 0) & (idx > 0) & ~seen
        prev = np.concatenate([[0], ccc[:-1]])
        ok &= np.where(ccc == 0, True, (cand == idx - 1) | ((prev < ccc) & (prev > 0)))
        i = np.flatnonzero(ok)
        i = i[row[cand[i]] == row[i]]
        if not len(i):
            break
        key = p[cand[i]].astype(np.int64) << 21 | p[i]
        k = np.searchsorted(t["pairs"], key)
        k[k == len(t["pairs"])] = 0
        hit = t["pairs"][k] == key
        i, k = i[hit], k[hit]
        if not len(i):
            break
        first = np.concatenate([[True], cand[i][1:] != cand[i][:-1]])
        i, k = i[first], k[first]
        p = p.copy()
        p[cand[i]] = t["comp"][k]
        keep = np.ones(len(p), bool)
        keep[i] = False
        p, row, ccc, seen = p[keep], row[keep], ccc[keep], seen[keep]
    return p, row


def plain_points(points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain form of the rows that hold anything to do: their numbers, new code points and new offsets."""
    t = _tables()
    n = len(offs) - 1
    touched = np.concatenate([[0], np.cumsum(t["touched"][entries(points)], dtype=np.int64)])
    rows = np.flatnonzero(touched[offs[1:]] > touched[offs[:-1]])
    if not len(rows):
        return rows, points[:0], np.zeros(1, np.int64)
    lens = (offs[1:] - offs[:-1])[rows]
    take = np.repeat(offs[rows] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
    p, row = points[take], np.repeat(np.arange(len(rows), dtype=np.int64), lens)
    # A carriage return before a line feed is part of the same break.
    pair = np.concatenate([(p[:-1] == 13) & (p[1:] == 10) & (row[:-1] == row[1:]), [False]])
    p, row = p[~pair], row[~pair]
    which = t["index"][entries(p)]
    size = np.where(which > 0, t["lens"][which], 1)
    src = np.repeat(np.arange(len(p)), size)
    within = np.arange(len(src)) - np.repeat(np.cumsum(size) - size, size)
    w = which[src]
    p = np.where(w > 0, t["chars"][np.minimum(t["starts"][w] + within, len(t["chars"]) - 1)], p[src]).astype(np.int32)
    row = row[src]
    p, row = _compose(p, row, t)
    low = entries(p)
    has_mixed = np.zeros(len(rows), bool)
    has_mixed[row[t["mixed"][low]]] = True
    m = t["marks"][low]
    p = np.where((m > 0) & ~has_mixed[row], m, p)
    low = entries(p)
    letter = t["word"][low]
    if len(p):
        start = letter & ~np.concatenate([[False], letter[:-1] & (row[1:] == row[:-1])])
        word = np.cumsum(start)
        latin = np.zeros(int(word[-1]) + 1, bool)
        latin[word[letter & t["latin"][low]]] = True
        to = t["look"][low]
        p = np.where(letter & (to > 0) & latin[word], to, p)
    return rows, p.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))]).astype(np.int64)


def plain_column(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The plain form of every row, and for each row whether it differed (never for null)."""
    n = len(column)
    null = np.asarray(column.is_null())
    points, offs = code_points(column)
    rows, new, at = plain_points(points, offs)
    differs = np.zeros(n, bool)
    if not len(rows):
        return column.cast(pa.large_string()), differs
    old_len, new_len = (offs[1:] - offs[:-1])[rows], at[1:] - at[:-1]
    equal = old_len == new_len
    both = np.repeat(equal, new_len)  # rows of equal length are compared character by character
    if both.any():
        pos = np.repeat(offs[rows] - at[:-1], new_len) + np.arange(len(new))
        wrong = np.bincount(np.repeat(np.arange(len(rows)), new_len)[both], weights=points[pos[both]] != new[both], minlength=len(rows)) > 0
        equal &= ~wrong
    differs[rows[~equal]] = True
    lens = offs[1:] - offs[:-1]
    out_lens = lens.copy()
    out_lens[rows] = new_len
    out_offs = np.concatenate([[0], np.cumsum(out_lens)])
    out = np.empty(out_offs[-1], np.int32)
    fresh = np.zeros(n, bool)
    fresh[rows] = True
    out[np.repeat(~fresh, out_lens)] = points[np.repeat(~fresh, lens)]
    out[np.repeat(fresh, out_lens)] = new
    return texts(out, out_offs, null), differs


def pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, end row) of pieces of about CHUNK bytes."""
    piece, at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)) // CHUNK, 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(piece, piece[at], side="right")))
        yield at, end
        at = end


def plain_array(column: pa.Array) -> pa.Array:
    """The plain form of every row of a text column, null for null."""
    out = []
    for at, end in pieces(column):
        part = column.slice(at, end - at)
        rows, new, offs = plain_points(*code_points(part))
        if len(rows):
            mask = np.zeros(len(part), bool)
            mask[rows] = True
            part = pc.replace_with_mask(part.cast(pa.large_string()), pa.array(mask), texts(new, offs, np.zeros(len(rows), bool))).cast(column.type)
        out.append(part)
    return pa.concat_arrays(out) if out else column
