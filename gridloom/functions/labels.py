"""Scalar functions over labels, notes and metadata texts, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import text as X

# Endings and words that tell what kind of term a glossary entry is.
PLACE_ENDINGS = ("특별시", "광역시", "특별자치시", "특별자치도", "도", "시", "군", "구", "읍", "면", "동", "리")
NOT_PLACES = ("지구", "기구", "연구")
PLACE_WORDS = ("city", "county", "district", "province", "-do")
BODY_ENDINGS = ("부", "처", "청", "위원회", "공사", "공단", "연구원", "진흥원", "협회", "재단")
BODY_WORDS = ("ministry", "commission", "agency", "institute", "corporation")
EVENT_ENDINGS = ("대회", "축제", "박람회", "행사", "기념일")
PLACE_LEVELS = (("시도", ("특별시", "광역시", "특별자치시", "특별자치도", "도")), ("시군구", ("시", "군", "구")), ("읍면동", ("읍", "면", "동", "리")))
BODY_LEVELS = (("위원회", ("위원회",)), ("중앙부처", ("부", "처")), ("공공기관", ("공사", "공단", "재단", "연구원", "진흥원", "협회", "병원")), ("산하기관", ("청", "원", "본부", "실")))
EVENT_LEVELS = (("박람회", ("박람회",)), ("기념일", ("기념일",)), ("기념행사", ("추모행사",)), ("행사", ("행사",)), ("정책사업", ("사업",)), ("제도명", ("제도",)))
# Titles that stand before an officer's name in a contact.
ROLES = ("주무관", "사무관", "서기관", "연구사", "전문관", "과장", "팀장", "센터장", "담당자", "경위", "소방경", "소방위", "행정실무원")
# Subject areas by a code's first number, and the colours of two of them.
DOMAINS = {"1": "조직", "2": "행정관리", "3": "전자정부", "4": "지방행정", "5": "지방재정", "6": "안전", "7": "재난관리", "8": "민방위", "9": "비상대비"}
THEMES = {"6": "red", "7": "green"}


def _any_end(t: Column, endings: tuple[str, ...]) -> Column:
    return t.rlike(f"(?:{'|'.join(endings)})$")


def _any_in(t: Column, words: tuple[str, ...]) -> Column:
    return t.rlike("|".join(words))


def _first(pairs: tuple[tuple[str, Column], ...], other: str) -> Column:
    return F.coalesce(*[F.when(c, F.lit(v)) for v, c in pairs], F.lit(other))


def source_key(t: Column) -> Column:
    """The key of a glossary term: lower case without white space, marks, brackets and quotes."""
    return F.lower(F.regexp_replace(t, r"""(?U)[\s·･,._\-–—()\[\]{}'"/]+""", ""))


def target_key(t: Column) -> Column:
    """The key of an English term: broken words joined, every other run of marks one blank."""
    joined = F.regexp_replace(t, r"([A-Za-z])(?:\s+-\s*|-\s+)([A-Za-z])", "$1$2")
    return F.trim(F.regexp_replace(F.lower(joined), "[^a-z0-9]+", " "))


def lookup_text(t: Column) -> Column:
    """A term as it is looked up: formulas in brackets taken out unless nothing else is left."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, X.WS, " "), r"^[ :;|/]+|[ :;|/]+$", "")
    bare = clean(F.regexp_replace(t, r"\([^)]*[A-Za-z][A-Za-z0-9+*/= -]*\)", ""))
    return F.when(bare != "", bare).otherwise(clean(t))


def category(source: Column, target: Column) -> Column:
    """Kind of a glossary term, by its ending and the words of its English name."""
    s, t = F.regexp_replace(source, X.WS, ""), F.lower(target)
    place = ~_any_end(s, NOT_PLACES) & _any_end(s, PLACE_ENDINGS) & _any_in(t, PLACE_WORDS)
    return _first((("행정구역명", place), ("기관명", _any_end(s, BODY_ENDINGS) | _any_in(t, BODY_WORDS)), ("행사·사업명", _any_end(s, EVENT_ENDINGS))), "일반 용어")


def subcategory(source: Column, kind: Column) -> Column:
    s = F.regexp_replace(source, X.WS, "")
    of = lambda levels, other: _first(tuple((v, _any_end(s, e)) for v, e in levels), other)
    return F.when(kind == "행정구역명", of(PLACE_LEVELS, "행정구역 일반")).when(kind == "기관명", of(BODY_LEVELS, "기관 일반")).when(kind == "행사·사업명", of(EVENT_LEVELS, "행사·사업 일반")).otherwise("일반")


#: English words of a label: Latin runs of two letters and more after a blank or at the start; units in brackets aren't.
ENGLISH = r"(^|\s)([A-Za-z0-9]*[A-Za-z][A-Za-z0-9 ,.'&/-]*[A-Za-z])"


def english_label(t: Column) -> Column:
    """The English words of a label, or null."""
    return F.nullif(F.array_join(F.transform(F.regexp_extract_all(X.display(X.join_hyphenated(t)), F.lit(ENGLISH), F.lit(2)), lambda x: F.trim(x)), " "), F.lit(""))


def korean_label(t: Column) -> Column:
    """A label without its English words and without brackets that only close; the whole label if nothing is left."""
    shown = X.display(X.join_hyphenated(t))
    rest = F.regexp_replace(X.display(F.regexp_replace(shown, ENGLISH, "$1")), "^[ /]+|[ /]+$", "")
    rest = F.when(rest.contains("구분") & rest.contains("지역") & F.lower(shown).contains("region"), "지역").otherwise(rest)
    rest = balanced(F.regexp_replace(rest, "^구분([^ ])", "구분 / $1"))
    return F.when(rest != "", rest).otherwise(shown)


#: Stand-ins for brackets that have their partner.
OPEN, CLOSE = "\ue000", "\ue001"


def balanced(t: Column) -> Column:
    """Brackets that only close taken out, but for those after a digit (`1)`); brackets nest up to four deep."""
    for _ in range(4):
        t = F.regexp_replace(t, r"\(([^()]*)\)", f"{OPEN}$1{CLOSE}")
    return F.trim(F.translate(F.regexp_replace(t, r"(^|[^0-9])\)", "$1"), OPEN + CLOSE, "()"))


def footnote_markers(notes: Column) -> Column:
    """The markers (`1)`) that a note defines (`주1)`), in order."""
    return F.transform(F.array_distinct(F.regexp_extract_all(notes, F.lit(r"주\s*(\d+)\)"), F.lit(1))), lambda x: F.concat(x, F.lit(")")))


def footnote_split(t: Column, markers: Column) -> Column:
    """struct(text, marker): a defined marker at the end of a text whose brackets aren't balanced; a year's marker; else the text alone.

    A number like `0,123` loses the zero before the comma.
    """
    bare = F.regexp_replace(t, r"\s+$", "")
    opened, closed = (F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit(""))) for c in "()")
    fits = F.filter(markers, lambda m: bare.endswith(m) & (F.length(bare) > F.length(m)))
    longest = F.element_at(F.array_sort(F.transform(fits, lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m")))), 1)["m"]
    marker = F.when((F.size(fits) > 0) & ~((opened > 0) & (opened == closed)), longest)
    year = r"^(\d{4})\s*(\d+\))$"
    text = F.when(marker.isNotNull(), F.rtrim(F.substring(bare, F.lit(1), F.length(bare) - F.length(marker)))).when(bare.rlike(year), F.regexp_extract(bare, year, 1)).otherwise(F.trim(bare))
    return F.struct(F.regexp_replace(text, r"^([+-]?)0,0*(\d+(?:\.\d+)?)$", "$1$2").alias("text"), F.coalesce(marker, F.when(bare.rlike(year), F.regexp_extract(bare, year, 2)), F.lit("")).alias("marker"))


def caption(context: Column) -> Column:
    """The caption `▫ ...` of a part, up to a bracket; '' if there is none."""
    return X.display(X.join_hyphenated(F.regexp_extract(context, r"▫\s*([^()▫]+)", 1)))


def domain(code: Column, names: dict[str, str] = DOMAINS, other: str = "통계") -> Column:
    chapter = F.substring_index(code, "-", 1)
    return _first(tuple((v, chapter == k) for k, v in names.items()), other)


def theme(code: Column) -> Column:
    return domain(code, THEMES, "blue")


def has_term(t: Column, term: str) -> Column:
    """Whether a text has a Korean term as a word of its own; 계 not within other words that hold it."""
    if term == "계":
        return ~t.rlike(r"통\s*계\s*청|회\s*계|계\s*곡") & t.rlike(r"(^|[\s/·])계($|[\s/·])")
    return t.rlike(rf"(^|[^가-힣A-Za-z]){term}($|[^가-힣A-Za-z])")


def punctuation(t: Column) -> Column:
    """Why a text's punctuation is suspicious, or null: broken characters, a wrong mark between digits, a doubled mark between words."""
    return (
        F.when(t.rlike(r"[\x{fffd}\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]"), "broken character")
        .when(t.rlike("[0-9][ㅡㆍ'’`´][0-9]"), "wrong mark between digits")
        .when(t.rlike("[가-힣A-Za-z0-9][,.;:]{2,}[가-힣A-Za-z0-9]"), "doubled mark")
    )


def decoded(t: Column) -> Column:
    """A URL-encoded text as it is read; a plus stays a plus, a text that isn't encoded right stays as it is."""
    return F.coalesce(F.nullif(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), F.lit("")), t)


def sheet_base(t: Column) -> Column:
    """A name that a sheet may have: no forbidden mark, at most 31 characters."""
    name = F.substring(F.regexp_replace(F.regexp_replace(t, r"[\[\]:*?/\\]", "_"), "^[ ']+|[ ']+$", ""), 1, 31)
    return F.when(name != "", name).otherwise("통계")


def sheet_name(base: Column, turn: Column) -> Column:
    """The name of the turn-th sheet of one base name."""
    end = F.concat(F.lit("_"), turn.cast("string"))
    return F.when(turn == 1, base).otherwise(F.concat(F.substring(base, F.lit(1), F.lit(31) - F.length(end)), end))


def column_letters(n: Column) -> Column:
    """Letters of the n-th column (from 1) of a sheet, up to three."""
    digit = lambda x: F.chr(F.lit(65) + x)
    one, two, three = (n - 1) % 26, F.floor((n - 27) / 26) % 26, F.floor((n - 703) / 676) % 26
    return F.concat(F.when(n > 702, digit(three)).otherwise(""), F.when(n > 26, digit(two)).otherwise(""), digit(one))


def cell_range(rows: Column, cols: Column) -> Column:
    return F.concat(F.lit("A1:"), column_letters(cols), rows.cast("string"))


PHONE = r"0\d{1,2}[-)]?\s*\d{3,4}-\d{4}"
CONTACT = rf"([가-힣A-Za-z0-9·･ ]*[가-힣A-Za-z0-9])\s+({'|'.join(ROLES)})\s+([가-힣]{{2,6}})"


def contacts(t: Column) -> Column:
    """struct(departments, officers, phones, reference) of a source text: every contact `department role name`, every phone, and what else it names."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\\", ""), r"^\s*[*＊※ㆍ·-]\s*", ""), X.WS, " "))
    distinct = lambda g: F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(CONTACT), F.lit(g)), lambda x: F.trim(x)))
    officers = F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(CONTACT), F.lit(0)), lambda x: F.concat_ws(" ", F.regexp_extract(x, CONTACT, 2), F.regexp_extract(x, CONTACT, 3))))
    phones = F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(PHONE), F.lit(0)), lambda x: F.replace(F.regexp_replace(x, r"\s+", ""), F.lit(")"), F.lit("-"))))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, PHONE, ""), CONTACT, ""), r"^[ *()/,;|-]+|[ *()/,;|-]+$", "")
    return F.struct(distinct(1).alias("departments"), officers.alias("officers"), phones.alias("phones"), rest.alias("reference"))


def is_temporal(t: Column) -> Column:
    """Whether a text is a date or period in Korean notation and nothing else."""
    return t.rlike("[0-9]") & t.rlike("[년월일]") & t.rlike(r"^[0-9\s'’.,:/~～\-–—()년월일이후전부터까지]+$")


def temporal_english(t: Column) -> Column:
    day = r"^(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일$"
    iso = F.concat_ws("-", F.regexp_extract(t, day, 1), F.lpad(F.regexp_extract(t, day, 2), 2, "0"), F.lpad(F.regexp_extract(t, day, 3), 2, "0"))
    other = t
    for a, b in (("년", ""), ("월", "-"), ("일", ""), ("이후", " and after"), ("이전", " and before"), ("부터", " from"), ("까지", " through")):
        other = F.replace(other, F.lit(a), F.lit(b))
    return F.when(t.rlike(day), iso).otherwise(X.display(other))


def stated_unit(context: Column) -> Column:
    """The unit after `단위:` in a context, or ''."""
    return F.trim(F.regexp_extract(context, r"단위\s*[:：]\s*([^)）]+)", 1))


def stated_date(context: Column) -> Column:
    """The base date (`2025. 12. 31. 기준`) of a context as `2025. 12. 31.`, a period (`제3기: 2020. 1. ~ 2022. 6.`) in full years, or ''."""
    day = r"(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})\s*\.?\s*기준"
    term = r"\[\s*제\s*(\d+)\s*기\s*[:：]\s*[’']?(\d{2,4})\s*\.\s*(\d{1,2})\s*\.?\s*[~∼-]\s*[’']?(\d{2,4})\s*\.\s*(\d{1,2})\s*\.?\s*\]"
    n = lambda p, g: F.regexp_extract(context, p, g).try_cast("int").cast("string")
    year = lambda g: F.when(F.length(F.regexp_extract(context, term, g)) == 2, F.concat(F.lit("20"), F.regexp_extract(context, term, g))).otherwise(F.regexp_extract(context, term, g))
    period = F.concat(F.lit("제"), n(term, 1), F.lit("기: "), year(2), F.lit(". "), n(term, 3), F.lit(". ~ "), year(4), F.lit(". "), n(term, 5), F.lit("."))
    return F.when(context.rlike(day), F.concat(n(day, 1), F.lit(". "), n(day, 2), F.lit(". "), n(day, 3), F.lit("."))).when(context.rlike(term), period).otherwise("")


def date_only(t: Column) -> Column:
    """`2025-01-02 03:04:05` as its date; any other text as it is."""
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.substring(t, 1, 10)).otherwise(t)


def with_unit(x: Column, unit: Column) -> Column:
    """A number as shown: whole with commas, else one decimal, with its unit unless that is a dash or a percentage."""
    body = F.when(x == F.floor(x), F.format_number(x, 0)).otherwise(F.format_number(x, 1))
    return F.when(F.coalesce(unit, F.lit("")).isin("", "-", "%"), body).otherwise(F.concat(body, unit))


def compact_korean(x: Column) -> Column:
    """A number in 만, 억 or 조, with one decimal at most."""
    scaled = lambda p: F.regexp_replace(F.format_number(F.round(x / p, 1), 1), r"\.0$", "")
    out = F.when(F.abs(x) >= 1e12, F.concat(scaled(1e12), F.lit("조"))).when(F.abs(x) >= 1e8, F.concat(scaled(1e8), F.lit("억"))).when(F.abs(x) >= 1e4, F.concat(scaled(1e4), F.lit("만")))
    return F.coalesce(out, scaled(1.0))


def column_role(head: Column) -> Column:
    """label kinds of a column by its header: date, total, ratio, formula, ratio_formula or value."""
    key = X.normalize(head)
    return (
        F.when(X.is_schedule(head), "date").when(key.rlike("계|합계|총계|소계|total"), "total").when(key.rlike("비율|비중|증감률|율|잔액률|rate|ratio|percent"), "ratio")
        .when(head.rlike(r"(?i)\([a-z]\s*="), "formula").when(head.rlike(r"(?i)\([a-z]\s*/\s*[a-z]"), "ratio_formula").otherwise("value")
    )


def row_role(label: Column) -> Column:
    """total, subtotal, region, year, ratio or item."""
    key, regions = X.normalize(label), [k for k in X.REGIONS if len(k) == 2]
    return (
        F.when(total_kind(label) == "total", "total").when(key.startswith("소계") | key.contains("subtotal"), "subtotal").when(F.substring(X.display(label), 1, 2).isin(*regions), "region")
        .when(key.rlike(r"^\d{4}$"), "year").when(key.rlike("비율|비중|증감률|율|잔액률"), "ratio").otherwise("item")
    )


def total_kind(label: Column) -> Column:
    """total or subtotal of a label that names one, else null; the words must stand by themselves."""
    d = X.display(label)
    return F.when(d.rlike(r"^소 ?계($|[ (:\[])") | d.rlike(r"(?i)(^|[^a-z])sub[ -]?total($|[^a-z])"), "subtotal").when(
        d.rlike(r"^(합 ?계|총 ?계)($|[ (:\[])") | d.rlike(r"(?i)^계( +(total|sum)($|[^a-z])| *$| *[(:\[])") | d.rlike(r"(?i)^(grand )?total($|[^a-z])"), "total"
    )


def is_per_unit(label: Column) -> Column:
    """Whether a label is a measure per person, case, household..; the Korean wording decides where there is any."""
    korean = X.normalize(label).rlike("(1인|인|건|개|명|회|가구|세대|대|기관)당")
    return korean | ~X.has_hangul(label) & label.rlike(r"(?i)(^|[^a-z])per (person|capita|case|task|item|household|organization|unit)($|[^a-z])")


def is_average(label: Column) -> Column:
    """Whether a label names an average; the English words must stand by themselves (`Daytime and ..` holds no mean)."""
    return label.rlike("평균") | label.rlike("(?i)(^|[^a-z])(average|mean)($|[^a-z])")


def is_growth(label: Column) -> Column:
    return X.normalize(label).rlike("증감률|증감율|증가율|증가률|감소율|감소률|성장률|growthrate")


def is_change_amount(label: Column) -> Column:
    return X.normalize(label).rlike("증감|증가|감소|change") & ~is_growth(label)


def is_count_unit(unit: Column) -> Column:
    """Whether sums in this unit must be exact: a single unit of counting, unscaled."""
    return ~unit.rlike("[,%/·･]") & X.normalize(unit).isin("명", "개", "개소", "건", "회", "종", "곳", "대", "가구", "세대", "필지", "동")
