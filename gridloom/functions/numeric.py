"""Scalar number semantics of grids: the strict number grammar, null policies, display, tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks for "no value"; dashes that count as zero in sums, and in sums across tables.
PLACEHOLDERS = ("", "-", "－", "―", "–", "—", "_", "＿")
SUM_DASHES = ("-", "－", "―", "_", "＿")
CROSS_DASHES = ("-", "－", "―")
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_N = r"[+-]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]+)?"


def compact(text: Column) -> Column:
    """Wide forms narrow, minus signs plain, white space out."""
    return F.regexp_replace(F.translate(text, _WIDE + "−", _NARROW + "-"), r"(?U)\s+", "")


def parse_number(text: Column) -> Column:
    """The number a cell text is, or null.

    Grouping must be exact, a trailing % is dropped without scaling, brackets around a number don't negate it, and a
    bracketed percentage after a number is ignored.
    """
    t = compact(text)
    t = F.regexp_replace(t, rf"^({_N})\({_N}%\).*$", "$1")
    t = F.regexp_replace(t, rf"^\(({_N})\)$", "$1")
    return F.when(t.rlike(rf"^{_N}%?$"), F.regexp_replace(t, "[,%]", "").cast("double"))


def raw_value(number: Column, text: Column) -> Column:
    """RAW policy: the stored number, else the parsed text; blank and dash are null."""
    return F.coalesce(number, parse_number(text))


def display(text: Column) -> Column:
    """White space collapsed; null is the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def target_value(number: Column, text: Column) -> Column:
    """TARGET policy: as RAW, a dash is 0."""
    return F.coalesce(raw_value(number, text), F.when(display(text).isin(*SUM_DASHES), 0.0))


def operand_value(number: Column, text: Column) -> Column:
    """OPERAND policy of a cell that exists: as TARGET, blank is 0."""
    return F.coalesce(target_value(number, text), F.when(display(text) == "", 0.0))


def cross_value(number: Column, text: Column, blank_as_zero: bool) -> Column:
    """CROSS policy: as RAW, a dash is 0, blank is 0 or null."""
    v = F.coalesce(raw_value(number, text), F.when(display(text).isin(*CROSS_DASHES), 0.0))
    return F.coalesce(v, F.when(display(text) == "", 0.0)) if blank_as_zero else v


def leading_value(number: Column, text: Column) -> Column:
    """LEADING policy: the stored number, else the number that the text starts with."""
    head = F.regexp_extract(compact(text), rf"^({_N})", 1)
    return F.coalesce(number, F.when(head != "", F.regexp_replace(head, ",", "").cast("double")))


def format_number(x: Column) -> Column:
    """Whole numbers with thousands commas, others with one decimal."""
    return F.when(x == F.floor(x), F.format_number(x, 0)).otherwise(F.format_number(x, 1))


#: What a cell that should be a number consists of.
SHAPE = "^[-+()0-9 ,.%'’`´ㅡㆍ·]+$"
COUNTED = "명|개|건|회|원|가구|세대|대|곳|krw"


def anomaly(text: Column, unit: Column, numbers: Column, grouped: Column, whole: Column) -> Column:
    """Kind of a malformed number text, or null.

    `numbers`, `grouped` and `whole` tell how many of the column's texts are numbers, have thousands commas, and are
    whole numbers. Dates, years like ’24 and numbers with a bracketed number after them are no anomaly.
    """
    t = compact(text)
    fine = t.isin(*PLACEHOLDERS) | t.rlike(r"^['’]?[0-9]{1,4}[./~-][0-9]{1,2}([./~-][0-9]{1,2})?[.]?$") | t.rlike("^['’][0-9]{2}$") | t.rlike(rf"^{_N}\({_N}%?\)%?$") | ~t.rlike(SHAPE) | ~t.rlike("[0-9]")
    points = t.rlike(r"^[+-]?[0-9]{1,3}([.][0-9]{3})+$") & ~F.coalesce(unit, F.lit("")).contains("%")
    counted = F.lower(F.regexp_replace(F.coalesce(unit, F.lit("")), "[ (),]", "")).rlike(COUNTED)
    return (
        F.when(fine, F.lit(None).cast("string"))
        .when(t.rlike("[0-9][ㅡㆍ'’`´·][0-9]"), "wrong separator")
        .when(t.rlike("[0-9][,.]{2,}[0-9]"), "doubled separator")
        .when(t.rlike(rf"^{_N}%?\)$"), F.when(numbers >= 2, "unmatched bracket"))
        .when(t.contains(",") & ~t.rlike(rf"^\(?{_N}%?\)?$"), "wrong grouping")
        .when(points & (counted | (grouped >= 1) | (whole >= 3)), "point for comma")
        .when(parse_number(text).isNull(), "not a number")
    )


def peers(text: Column) -> list[Column]:
    """The aggregates that anomaly() wants of a column's texts: numbers, grouped, whole."""
    t = F.regexp_replace(compact(text), "%$", "")
    comma = t.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+$")
    return [F.count(parse_number(text)).alias("numbers"), F.count_if(comma).alias("grouped"), F.count_if(comma | t.rlike("^[+-]?[0-9]+$")).alias("whole")]
