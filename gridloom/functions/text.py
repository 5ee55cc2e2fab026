"""Scalar text functions as Catalyst expressions; the few that need Unicode tables or difflib are Arrow-batched."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Every kind of white space, for Java's regular expressions.
WS = r"(?U)\s+"
CODE = r"^(\d+(?:-\d+){1,5})(?:\s+표\s*(\d+))?$"
#: Region names, short and official, and their English names.
REGIONS = {
    "서울": "Seoul", "부산": "Busan", "대구": "Daegu", "인천": "Incheon", "광주": "Gwangju", "대전": "Daejeon", "울산": "Ulsan", "세종": "Sejong",
    "경기": "Gyeonggi", "강원": "Gangwon", "충북": "Chungbuk", "충남": "Chungnam", "전북": "Jeonbuk", "전남": "Jeonnam", "경북": "Gyeongbuk", "경남": "Gyeongnam", "제주": "Jeju",
    "서울특별시": "Seoul", "부산광역시": "Busan Metropolitan City", "대구광역시": "Daegu Metropolitan City", "인천광역시": "Incheon Metropolitan City", "광주광역시": "Gwangju Metropolitan City", "대전광역시": "Daejeon Metropolitan City", "울산광역시": "Ulsan Metropolitan City", "세종특별자치시": "Sejong Special Self-Governing City",
    "경기도": "Gyeonggi-do", "강원특별자치도": "Gangwon State", "충청북도": "Chungcheongbuk-do", "충청남도": "Chungcheongnam-do", "전북특별자치도": "Jeonbuk State", "전라남도": "Jeollanam-do", "경상북도": "Gyeongsangbuk-do", "경상남도": "Gyeongsangnam-do", "제주특별자치도": "Jeju Special Self-Governing Province",
}


def normalize(t: Column) -> Column:
    """White space and the marks ·,._-()/% out, lower case: the key texts are compared by."""
    return F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)[\s·,._\-()/%]+", ""))


def display(t: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), WS, " "))


def join_hyphenated(t: Column) -> Column:
    """A word broken by a hyphen at a line's end is one word again."""
    return F.regexp_replace(t, r"(?<=[A-Za-z])-[ \t]*\r?\n[ \t]*(?=[a-z])", "")


def review_text(t: Column) -> Column:
    """The form texts are reviewed in: composed, broken words joined, no-break spaces plain, white space collapsed."""
    return display(join_hyphenated(F.translate(nfc(t), "\u00a0", " ")))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two texts; null is the empty text."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def has_hangul(t: Column) -> Column:
    return t.rlike("[가-힣]")


def has_latin(t: Column) -> Column:
    return t.rlike("[A-Za-z]{2,}")


def has_language(t: Column) -> Column:
    return t.rlike("[가-힣]|[A-Za-z]{2,}")


def bilingual_pair(t: Column) -> Column:
    """struct(ko, en) of a text of a Korean line and an English line, or of Korean words followed by English ones; null if it isn't such a pair."""
    d = F.trim(t)
    lines = F.split(d, r"\s*\n\s*")
    two = (F.size(lines) == 2) & has_hangul(lines[0]) & ~lines[0].rlike("[a-z]{2,}") & has_latin(F.try_element_at(lines, F.lit(2))) & ~has_hangul(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")))
    inline = r"^([가-힣][가-힣0-9·()+A-Z ]*?)\s+([A-Za-z][A-Za-z0-9 ,.'&()/-]+)$"
    one = (F.size(lines) == 1) & d.rlike(inline) & ~F.regexp_extract(d, inline, 1).rlike("[a-z]")
    return F.when(two, F.struct(lines[0].alias("ko"), F.try_element_at(lines, F.lit(2)).alias("en"))).when(one, F.struct(F.trim(F.regexp_extract(d, inline, 1)).alias("ko"), F.regexp_extract(d, inline, 2).alias("en")))


def is_total(t: Column) -> Column:
    n = normalize(t)
    return n.rlike("^(계|합계|총계|소계|누계|전체)(total|$)") | n.rlike("^(합계|총계|소계)") | n.rlike("^(grandtotal|total|subtotal)$")


def is_subtotal(t: Column) -> Column:
    n = normalize(t)
    return n.startswith("소계") | n.contains("subtotal")


def is_ratio(t: Column) -> Column:
    return normalize(t).rlike("비율|비중|증감률|율$|률$") | t.rlike(r"(?i)\b(rate|ratio|percent|percentage)\b")


def is_additive(t: Column) -> Column:
    """Whether values of a column with this header may be summed."""
    return ~(normalize(t).rlike("평균|비율|비중|증감률|잔액율|잔액률|율|1인당|내용|비고|remarks") | t.rlike(r"(?i)\b(rate|average|ratio|percent|percentage|per\s+person|per\s+capita|details?|remarks?)\b"))


def is_schedule(t: Column) -> Column:
    return normalize(t).rlike("일자|일시|날짜|기간") | t.rlike(r"(?i)\b(dates?|period|schedule)\b")


def year_of(t: Column) -> Column:
    """The year a label stands for, or null."""
    y = F.regexp_extract(display(t), r"^[’']?((?:19|20)\d{2})\s*(?:년|[.(]|$)", 1)
    return F.nullif(y, F.lit("")).cast("int")


def translate_region(t: Column) -> Column:
    """English of a region name or of a comma-separated list of them; null if one is unknown."""
    names = F.create_map(*[x for k, v in REGIONS.items() for x in (F.lit(k), F.lit(v))])
    parts = F.transform(F.split(t, r"\s*,\s*"), lambda x: names[F.trim(x)])
    return F.when(~F.exists(parts, lambda x: x.isNull()), F.array_join(parts, ", "))


def phone_digits(t: Column) -> Column:
    return F.regexp_replace(t, r"[^0-9]", "")


def last_department(t: Column) -> Column:
    """The last station of `A -> B`."""
    return F.trim(F.element_at(F.split(t, r"\s*(?:->|→|⇒)\s*"), -1))


def department_key(t: Column) -> Column:
    """Department without blanks and without the 실 of an officer's office."""
    return F.regexp_replace(F.regexp_replace(last_department(t), WS, ""), r"담당관실$", "담당관")


def same_department(a: Column, b: Column) -> Column:
    """Equal keys, or one is the other with an organisation before it."""
    x, y = department_key(a), department_key(b)
    return (x == y) | (x.endswith(y) & (F.length(y) >= 3)) | (y.endswith(x) & (F.length(x) >= 3))


def masked(t: Column) -> Column:
    """Numbers replaced by a placeholder."""
    return F.regexp_replace(t, r"[0-9][0-9,.]*", "<NUM>")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over the parts; null counts as the empty text."""
    return F.sha2(F.concat_ws("", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def same_words(a: Column, b: Column) -> Column:
    """Whether two texts have the same words in any order."""
    words = lambda t: F.array_sort(F.regexp_extract_all(F.lower(t), F.lit(r"[a-z0-9가-힣]+"), F.lit(0)))
    return words(a) == words(b)


def token_overlap(a: Column, b: Column) -> Column:
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"[a-z0-9가-힣]+"), F.lit(0)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(a), words(b))), F.size(F.array_union(words(a), words(b)))), F.lit(0.0))


def chunks(t: Column, size: int = 1400) -> Column:
    """A text as array of pieces of at most `size` characters, parted at line breaks or sentence ends where there are any; nothing is lost but blanks at the cuts."""
    piece = rf"(?s)\S(?:.{{0,{size - 2}}}(?:(?<=[.!?。])(?=\s)|(?=\n)|(?=\s*$))|.{{0,{size - 1}}})"
    return F.filter(F.transform(F.regexp_extract_all(t, F.lit(piece), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
