"""Titles matched across lists, against every pair compared."""

import difflib
import random

from gridloom.operators.reconcile import match_over_years, match_titles, similar_titles


def _titles(rng, n):
    pool = "가나다라마바사아자차abc"
    out = []
    for _ in range(n):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))
        out += [t, t[1:] + rng.choice(pool), t[:-1]]
    return sorted({t for t in out if t})


def test_no_similar_title_is_missed(spark):
    rng = random.Random(6)
    a, b = _titles(rng, 60), _titles(rng, 60)
    frame = lambda ts: spark.createDataFrame([(1, t) for t in ts], "block int, key string")
    for least in (0.58, 0.8):
        want = {(x, y) for x in a for y in b if difflib.SequenceMatcher(None, x, y).ratio() >= least}
        got = {(r.key, r.rkey) for r in similar_titles(frame(a), frame(b), least).collect()}
        assert got == want and want


def test_nearest_row_of_a_similar_title_and_the_year_before(spark):
    left = spark.createDataFrame([(1, 2024, "교량 상반기 현황", 0.9), (2, 2024, "저수지 현황표", 0.1), (3, 2024, "온실 야간 통계", 0.5), (4, 2024, "다른것", 0.5)], "left_id int, block int, title string, pos double")
    right = spark.createDataFrame([(10, 2024, "교량 상반기 현황표", 0.1), (11, 2024, "교량 상반기 현황표", 0.8), (12, 2024, "저수지 현황표", 0.9), (13, 2024, "저수지 현황표", 0.2), (14, 2023, "온실 야간 통계", 0.4), (15, 2024, None, 0.3)], "right_id int, block int, title string, pos double")
    got = {r.left_id: (r.right_id, r.method) for r in match_titles(left, right).collect()}
    assert got == {1: (11, "similar title"), 2: (13, "same title")}
    got = {r.left_id: (r.right_id, r.method) for r in match_over_years(left, right).collect()}
    assert got == {1: (11, "similar title"), 2: (13, "same title"), 3: (14, "year before: same title")}
    assert match_titles(left.limit(0), right).count() == 0 and match_titles(left, right.limit(0)).count() == 0
