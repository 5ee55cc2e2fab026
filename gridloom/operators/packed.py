"""Problem 5: several values packed in one field, split into one row per value with its place.

A parsing expression grammar with ordered alternatives:

    list   <- separator* (value (separator+ value)*)? separator*
    value  <- (quoted / bracketed / bare)+
    quoted <- open (doubled close / !close any)* close     tried first; without its close the mark is bare
    bracketed <- open (quoted / bracketed / !close any)* close   without its close the mark is bare
    bare   <- !separator any

It is run in one pass over the marks of a text: a quote that never closes backtracks to a bare mark (remembered, so
that the search for its close is made once), brackets are matched by a stack, so the time is linear in the text even
for thousands of unclosed brackets.

Defined results: null and blank texts have no values; empty values are neither counted nor given; quotes around a
whole value are dropped and a doubled quote in them means one; a malformed mark stays in its value and is flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import table

# Marks and breaks used for listing; quotes; brackets.
SEPARATORS = ",;/|\n\r\t\u000b\u000c\u0085\u2028\u2029，；／｜、﹐﹑﹔､"
QUOTES = {'"': '"', "“": "”", "„": "”", "‘": "’", "「": "」", "『": "』", "«": "»", "＂": "＂", "｢": "｣"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "｛": "｝", "〔": "〕", "【": "】", "〈": "〉", "《": "》", "〖": "〗"}

_OPENS = {close: open_ for open_, close in BRACKETS.items()}
_MARK = re.compile("[" + re.escape(SEPARATORS + "".join(QUOTES) + "".join(BRACKETS) + "".join(_OPENS)) + "]")


def _quoted(text: str, at: int, dead: dict[str, int]) -> int:
    """End of the quoted part that opens at `at`, or -1; a straight quote after a letter or digit opens none."""
    close = QUOTES[text[at]]
    if close == text[at] and at and text[at - 1].isalnum() or dead.get(close, len(text)) <= at:
        return -1
    end = at + 1
    while (end := text.find(close, end)) >= 0:
        if text.startswith(close, end + 1):  # doubled
            end += 2
            continue
        return end
    dead[close] = min(dead.get(close, len(text)), at)
    return -1


def split_values(text: str | None) -> tuple[list[str], str | None]:
    """The values of a text in order, and what was malformed (null if nothing was)."""
    if not text:
        return [], None
    cuts: list[int] = []  # separators outside of all closed brackets, in order
    stack: list[tuple[str, int, int]] = []  # open bracket, its place, separators seen before it
    open_kinds: dict[str, int] = {}
    dead: dict[str, int] = {}
    whole: dict[int, int] = {}  # quoted parts: start -> end
    wrong: set[str] = set()
    at = 0
    while m := _MARK.search(text, at):
        at, c = m.start(), m[0]
        if c in QUOTES and (end := _quoted(text, at, dead)) >= 0:
            whole[at] = end
            at = end + 1
            continue
        if c in BRACKETS:
            stack.append((c, at, len(cuts)))
            open_kinds[c] = open_kinds.get(c, 0) + 1
        elif c in _OPENS:
            if open_kinds.get(_OPENS[c], 0):
                while True:  # brackets left open inside of this one are bare
                    kind, _, before = stack.pop()
                    open_kinds[kind] -= 1
                    if kind == _OPENS[c]:
                        break
                    wrong.add("unclosed bracket")
                del cuts[before:]
            else:
                wrong.add("stray bracket")
        elif c in QUOTES:
            if not text[at - 1 : at].isalnum():
                wrong.add("unclosed quote")
        else:
            cuts.append(at)
        at += 1
    if stack:
        wrong.add("unclosed bracket")
    out, start = [], 0
    for end in [*cuts, len(text)]:
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if whole.get(a) == b - 1 and b - a > 1:
            value = text[a + 1 : b - 1].replace(QUOTES[text[a]] * 2, QUOTES[text[a]])
        else:
            value = text[a:b]
        if value.strip():
            out.append(value)
        start = end + 1
    return out, ", ".join(sorted(wrong)) or None


SPLIT = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("item", T.StringType()), T.StructField("error", T.StringType())])


def packed_values(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """row_id, pos (from 1), n (values of the row), item, error: one row per value of every text of df."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[list[str], str | None]] = {}
        for b in batches:
            rows, pos, n, items, errors = [], [], [], [], []
            for r, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = memo.get(text)
                if got is None:
                    got = split_values(text)
                    if len(text) <= 200:
                        if len(memo) > 50_000:
                            memo.clear()
                        memo[text] = got
                values, error = got
                rows += [r] * len(values)
                pos += range(1, len(values) + 1)
                n += [len(values)] * len(values)
                items += values
                errors += [error] * len(values)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(items, pa.string()), pa.array(errors, pa.string())], names=SPLIT.names)

    texts = df.select(F.col(id_column).cast("long").alias("row_id"), F.col(text_column).cast("string").alias("text"))
    return texts.where("text is not null and text <> ''").mapInArrow(kernel, SPLIT)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (("reference_owners", "owner_id", "officer_raw"), ("stat_tables", "id", "source"))
    owners, sources = (packed_values(table(spark, sf_dir, t), i, c).where("n >= 2").select(F.lit(f"{t}.{c}").alias("field_name"), "row_id", "pos", "item") for t, i, c in fields)
    return owners.unionAll(sources)


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_name, row_id, pos, n, item, error: every value, of texts with a single one too, and what was malformed in its text."""
    fields = (("reference_owners", "owner_id", "officer_raw"), ("stat_tables", "id", "source"))
    owners, sources = (packed_values(table(spark, sf_dir, t), i, c).select(F.lit(f"{t}.{c}").alias("field_name"), "row_id", "pos", "n", "item", "error") for t, i, c in fields)
    return owners.unionAll(sources)
