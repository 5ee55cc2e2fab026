import random
import re
from decimal import ROUND_HALF_UP, Decimal

from gridloom.functions.grid import NUMBER, REMARK
from gridloom.operators.units import converted, quantities, rounded, solve, unit_rows, unit_table
from gridloom.session import cut, lookup

KEYS = {k: (kind, n, d) for k, kind, n, d in unit_rows()}


def test_units_by_rule():
    assert KEYS["천명"] == ("persons", 1000, 1) and KEYS["krwmillion"] == ("money", 10**6, 1) and KEYS["1,000m2"] == ("area", 1000, 1)
    assert KEYS["평"] == ("area", 400, 121) and KEYS["천톤"] == ("weight", 10**6, 1) and KEYS["100millionwon"] == ("money", 10**8, 1)
    assert "개소" not in KEYS and "%" not in KEYS


_WHOLE = re.compile(rf"({NUMBER})(?:\s*(\S.*))?", re.DOTALL)
_LARGE = re.compile(rf"(?:({NUMBER})\s*조)?\s*(?:({NUMBER})\s*억)?\s*(?:({NUMBER})\s*만)?\s*({NUMBER})?\s*원")


def quantity(text):
    """(number, unit as written or '') of a plain cell text, one text at a time; None if it holds no number."""
    t = re.sub(REMARK, "", text).strip()
    if (m := _LARGE.fullmatch(t)) and sum(x is not None for x in m.groups()) > 1:
        return sum(Decimal((x or "0").replace(",", "")) * k for x, k in zip(m.groups(), (10**12, 10**8, 10**4, 1))), "*원"
    if m := _WHOLE.fullmatch(t):
        return Decimal(m[1].replace(",", "")), m[2] or ""
    return None


def test_quantity():
    assert quantity("1,234.5천 건") == (Decimal("1234.5"), "천 건")
    assert quantity("53억 3,397만원") == (Decimal(5333970000), "*원")
    assert quantity("206.60\n(54.9%)") == (Decimal("206.60"), "")
    assert quantity("12,34") != (Decimal(1234), "") and quantity("비공개") is None and quantity("-") is None


def test_numbers_are_exact(spark):
    """Digits and places, and the rounded product, against Decimal; beyond a bigint it is null, never a lost row."""
    rng = random.Random(8)
    texts = ["1,234.5천 건", "53억 3,397만원", "1.5억 2만원", "206.60\n(54.9%)", "12,34", "비공개", "-", "-7", "+0.5", "-0.5", "99999999999999999999", "0." + "1" * 20, "9" * 45, "1조 1원", "3억원", "5 (3%)", ""]
    texts += ["".join(rng.choice("0123456789,.") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(1000, None, 2.5e12), (1001, "", -0.125), (1002, None, None), (1003, None, float("nan")), (1004, None, 1e-7)], "id int, text_value string, numeric_value double")
    units = spark.createDataFrame([(1, 1), (400, 121), (10**12, 1), (1, 1000), (10**9, 1)], "num long, den long")
    got = {(r.id, r.num, r.den): r for r in rounded(quantities(df).crossJoin(units), "v").collect()}
    want = {i: quantity(t)[0] for i, t in enumerate(texts) if t and quantity(t)} | {1000: Decimal("2.5e12"), 1001: Decimal("-0.125"), 1004: Decimal("1e-7")}
    assert {k[0] for k in got} == set(want)
    for (i, num, den), r in got.items():
        exact = want[i] * num / den
        v = int(exact.quantize(Decimal(1), ROUND_HALF_UP)) if abs(exact) < 10**20 else 10**20
        if r.v is None:
            assert abs(v) >= 1 << 63 or len(want[i].as_tuple().digits) + len(str(num)) > 38, (i, num, den)
        else:
            assert r.v == v, (i, num, den, want[i], r.v, v)


def test_lookup_broadcast_and_salted(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "k int, r int")
    small = cut(spark.createDataFrame([(0, "a"), (1, "b")], "k int, v string"))
    rows = lambda few: sorted(map(repr, lookup(df, small, ["k"], "r", few).collect()))
    assert rows(10) == rows(0) and len(rows(0)) == 100


def _run(spark, tables, cells):
    t = spark.createDataFrame(tables, "id long, unit string")
    c = spark.createDataFrame(cells, "id long, table_id long, row_index int, col_index int, text_value string, numeric_value double, is_header boolean")
    return {r.cell_id: (r.common_unit, r.common_value, r.factor_is_one) for r in converted(spark, t, c).collect()}


def test_cell_before_header_before_table(spark):
    cells = [(1, 1, 0, 1, "면적(천㎡)\nArea", None, True), (2, 1, 0, 2, "예산", None, True), (3, 1, 1, 1, "1.5", None, False), (4, 1, 1, 1, "2km²", None, False), (5, 1, 1, 2, "７", None, False), (6, 1, 2, 2, None, 2.5, False), (7, 1, 3, 2, "", None, False), (8, 1, 4, 2, "10%", None, False), (9, 1, 5, 0, "5", None, False), (10, 1, 1, 2, "121평", None, False)]
    got = _run(spark, [(1, "(단위 : 백만 원)")], cells)
    assert got == {3: ("m2", 1500, False), 4: ("m2", 2_000_000, False), 5: ("원", 7_000_000, False), 6: ("원", 2_500_000, False), 10: ("m2", 400, False)}


def test_nulls_and_empty(spark):
    assert _run(spark, [(1, None)], [(1, 1, 1, 1, "5", None, False), (2, 1, 0, 1, None, None, True)]) == {}
    assert _run(spark, [], []) == {}


def test_identity_chooses_units(spark):
    """area = length * length settles which of the listed units a column is in; equal residuals are flagged."""
    values = spark.createDataFrame([(1, r, c, v) for r, (a, b, x) in enumerate([(6.0, 2.0, 3000.0), (20.0, 4.0, 5000.0)]) for c, v in ((1, a), (2, b), (3, x))], "table_id long, row_index int, col_index int, value double")
    cand = spark.createDataFrame([(1, 1, "km2"), (1, 1, "m2"), (1, 1, "ha"), (1, 2, "km"), (1, 3, "m"), (1, 3, "km")], "table_id long, col_index int, unit string")
    got = {r.col_index: (r.unit, r.is_unique) for r in solve(values, cand, unit_table(spark)).collect()}
    assert got == {1: ("km2", True), 3: ("m", True)}
    twin = spark.createDataFrame([(1, 1, "km2"), (1, 1, "제곱킬로미터"), (1, 2, "km"), (1, 3, "m")], "table_id long, col_index int, unit string")
    assert {r.col_index: r.is_unique for r in solve(values, twin, unit_table(spark)).collect()} == {1: False}


def test_stated_units_are_checked(spark):
    """A column with one candidate gets the residual of its unit as stated."""
    values = spark.createDataFrame([(1, r, c, v) for r, (a, b, x) in enumerate([(6.0, 2.0, 3.0), (20.0, 4.0, 5.0)]) for c, v in ((1, a), (2, b), (3, x))], "table_id long, row_index int, col_index int, value double")
    cand = spark.createDataFrame([(1, 1, "ha"), (1, 2, "m"), (1, 3, "m")], "table_id long, col_index int, unit string")
    got = {r.col_index: round(r.residual, 4) for r in solve(values, cand, unit_table(spark), stated=True).collect()}
    assert got == {1: 9.2103, 2: 9.2103, 3: 9.2103}
    assert solve(values, cand, unit_table(spark)).count() == 0
