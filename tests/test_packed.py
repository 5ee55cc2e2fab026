from hypothesis import given
from hypothesis import strategies as st

from gridloom.operators.packed import packed_values, split_values

CASES = {
    "a, b;c/d|e\nf\tg": ["a", "b", "c", "d", "e", "f", "g"],
    '"현황; 개정판"; 둘': ["현황; 개정판", "둘"],
    '"가 ""새길"" 백서"、둘': ['가 "새길" 백서', "둘"],
    '가 "새길" 백서/둘': ['가 "새길" 백서', "둘"],
    "「가; 나」,, 다": ["가; 나", "다"],
    "홍길동(총괄, 표 작성) // 이": ["홍길동(총괄, 표 작성)", "이"],
    "A·B 조사, www.x-y.example": ["A·B 조사", "www.x-y.example"],
    "a (b, c": ["a (b", "c"],
    'a "b, c': ['a "b', "c"],
    "a) b, c": ["a) b", "c"],
    " ; ,": [],
    '"", a': ["a"],
    "((a,b),c),d": ["((a,b),c)", "d"],
    "(a [b), c": ["(a [b)", "c"],
}


def test_cases():
    for text, want in CASES.items():
        assert split_values(text)[0] == want, text


def test_flags():
    assert split_values('a "b, c')[1] == "unclosed quote"
    assert split_values("a (b, c")[1] == "unclosed bracket"
    assert split_values("a) b, c")[1] == "stray bracket"
    assert split_values("a, b")[1] is None
    assert split_values(None) == ([], None) == split_values("")


def test_linear_on_malformed_texts():
    import time

    began = time.time()
    split_values("(" * 100_000 + "," * 50_000 + '"' * 50_001 + "「" * 50_000)
    assert time.time() - began < 20


@given(st.text(alphabet='ab"“”(),; \n「」[]', max_size=30))
def test_values_are_in_the_text(text):
    values, _ = split_values(text)
    assert all(v.strip() for v in values)
    assert sum(map(len, values)) <= len(text)


@given(st.lists(st.text(alphabet="abc가.·-", min_size=1, max_size=5), min_size=1, max_size=6))
def test_round_trip(values):
    assert split_values(" ; ".join(values))[0] == values
    assert split_values(",".join('"' + v.replace("a", '""') + '"' for v in values))[0] == [v.replace("a", '"') for v in values]


def test_frame(spark):
    df = spark.createDataFrame([(1, "a, b", 9), (2, None, 9), (3, "", 9), (4, "x", 9), (1, "a, b", 9)], "id long, row_id string, item int")
    got = sorted(tuple(r) for r in packed_values(df, "id", "row_id").select("row_id", "pos", "n", "item").collect())
    assert got == [(1, 1, 2, "a"), (1, 1, 2, "a"), (1, 2, 2, "b"), (1, 2, 2, "b"), (4, 1, 1, "x")]
    assert packed_values(df.limit(0), "id", "row_id").count() == 0
