"""Vectorised kernels against plain ones, and the edge cases of every text operator."""

import os
import random
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gridloom.functions.plainform import INVISIBLE_RANGES, plain_form
from gridloom.llm import leakage, names, queries, repetition, tokens
from gridloom.llm.canonical import mapping
from gridloom.llm.letters import letters, window_hash
from gridloom.llm.plain_text import not_plain, plain_column, with_plain

POOL = ["a", "e", "o", "u", "A", "é", "é", "̣", "̈", "가", "가", "ᆨ", "ᅡ", "한", " ", "\n", "·", "ㆍ", "​", "　", "а", "е", "ν", "Β", "“", "‘", "Ａ", "１", "ﬁ", "㎡", "²", "\U0001d400", "人", "金", "\r\n"]


def test_plain_kernel_agrees_with_plain_form():
    rng = random.Random(5)
    rows = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 12))) for _ in range(20_000)] + [None, "", "x" * 100_000 + "Ａ"]
    out, differs = plain_column(pa.array(rows))
    want = [plain_form(x) for x in rows]
    assert out.to_pylist() == want
    assert differs.tolist() == [a != b for a, b in zip(rows, want)]


def test_plain_kernel_takes_out_all_that_is_invisible():
    rows = [f"葛{chr(c)}1" for a, b in INVISIBLE_RANGES for c in range(a, b + 1)]
    rows += [f"{x}{chr(c)}\u2019" for x in ("a", "") for c in (0x2FFFF, 0x30000, 0x3134A, 0x3FFFF, 0x40000, 0xDFFFF, 0xE0000, 0xE0FFF, 0xE1000, 0xF0000, 0x10FFFF)]
    out, differs = plain_column(pa.array(rows))
    want = [plain_form(x) for x in rows]
    assert out.to_pylist() == want
    assert differs.tolist() == [a != b for a, b in zip(rows, want)]


def test_plain_frames(spark):
    df = spark.createDataFrame([(1, "Ａ", "x"), (2, None, None), (3, "", "y"), (4, "ok", "z"), (1, "Ａ", "x")], "id long, text string, plain_ string")
    assert sorted(r.row_id for r in not_plain(df, "f", "id", "text").collect()) == [1, 1]
    assert with_plain(df, "text").count() == 5
    assert not_plain(df.limit(0), "f", "id", "text").count() == 0
    with pytest.raises(ValueError):
        with_plain(df.withColumnRenamed("plain_", "plain"), "text")


def test_mapping(spark):
    refs = spark.createDataFrame([(1, "음식위생조사과"), (1, "Food Hygiene Survey Division"), (2, "공원녹지정책과"), (3, "공원녹지협력과"), (4, "FSPD4"), (5, "음식위생협력담당관"), (6, "둘다"), (7, "둘다"), (8, None), (10, "가나다라마바"), (11, "가나다라마사")], "entry_id long, name string")
    want = {
        "음식위생조사과": 1, " 음식 위생조사과* ": 1, "음식위생조사사과": 1, "음식생위조사과": 1, "음식위생조사과": 1, "FOOD HYGIENE SURVEY DIVISION": 1, "새들행정국 음식위생조사과": 1, "미정 -> 음식위생조사과 (확인)": 1,
        "음식위생조사과 → 구내식당": 0, "공원녹지정책과": 2, "공원녹지정협과": 2, "가나다라마아": 0, "FSPD4": 4, "FSPD5": 0, "음식위생협력담당관실": 5, "둘다": 0, "미정": 0, "->": 0,
    }
    typed = spark.createDataFrame([(t,) for t in [*want, *want, None, "  "]], "text string")
    got = {r.text: r.entry_id for r in mapping(spark, typed, refs).collect()}
    assert got == want
    assert mapping(spark, typed.limit(0), refs).count() == 0
    assert {r.entry_id for r in mapping(spark, typed, refs.limit(0)).collect()} == {0}


def test_names_forms_and_similarity():
    hwang = names.parts("황용팔")
    for t in ("황용팔", "황 용팔 서기관", "사무관 황용팔", "황용팔(총괄, 표 작성)", "Yong-pal Hwang", "Hwang Yongpal", "Y. Hwang", "Hwang Y.P.", "팔이 팀장", "용팔 주무관", "황팔", "황 사무관", "황옹팔", "황팔용", "황​용팔"):
        assert names.similarity(names.parts(t), hwang) > 0, t
    for t in ("김용팔", "황별찬", "Y. Kim", "팔야", "미정", ""):
        assert names.similarity(names.parts(t), hwang) == 0, t
    assert names.parts(None) == () == names.parts("담당자")
    b, r = names.bands()
    assert 1 - (1 - names.LIKE**r) ** b >= names.RECALL


#: (mention, the person meant); each of the forms in which people write names, among them the ones hard to link.
LABELLED = [
    ("황용팔", "황용팔"), ("황 용팔 서기관", "황용팔"), ("Hwang Yong Pal", "황용팔"), ("yong pal hwang", "황용팔"), ("Yong-Pal Hwang", "황용팔"), ("황옹팔", "황용팔"), ("황용용팔", "황용팔"), ("황황용팔", "황용팔"),
    ("Kim Chulsoo", "김철수"), ("Cheol-su Kim", "김철수"), ("Gim Cheolsu", "김철수"), ("Chul Soo Kim", "김철수"), ("철수 팀장", "김철수"), ("K. C. S.", None), ("C. Kim", "김철수"),
    ("Namgung Min", "남궁민"), ("민", "남궁민"), ("남궁민 과장", "남궁민"), ("남궁 사무관", "남궁민"), ("민 주무관", "남궁민"), ("Park Youngsoo", "박영수"), ("Pak Yeongsu", "박영수"), ("박영스", "박영수"), ("수영박", "박영수"),
    ("이순신", None), ("Lee Sunsin", None), ("공석", None), ("미정", None), ("최용팔", None), ("Hwang Minsu", None),
]


def test_labelled_names(spark):
    """Recall and precision over the labelled forms, through bands, verification and stars."""
    persons = spark.createDataFrame([(1, n) for n in ("황용팔", "김철수", "남궁민", "박영수")], "block long, name string")
    mentions = spark.createDataFrame([(1, m) for m, _ in LABELLED], "block long, name string")
    got = {(r.mention, r.person) for r in names.stars(names.links(mentions, persons)).collect()}
    want = {(m, p) for m, p in LABELLED if p}
    assert len(got & want) >= 0.9 * len(want), want - got
    assert len(got & want) >= 0.95 * len(got), got - want


def test_star_clusters(spark):
    """A spelling in the middle is the centre of those around it; others keep to themselves; no names, no stars."""
    names_ = [(1, "\x1f".join(x)) for x in ("한길동", "한긴동", "한길둥", "고나래", "한길동")] + [(2, "\x1f".join("한긴동")), (1, "나래".replace("나래", "나\x1f래"))]
    df = spark.createDataFrame(names_, "block long, spelling string")
    got = {(r.block, r.spelling.replace("\x1f", "")): r.centre.replace("\x1f", "") for r in names.star_clusters(df).collect()}
    assert got == {(1, "한길동"): "한길동", (1, "한긴동"): "한길동", (1, "한길둥"): "한길동", (1, "고나래"): "고나래", (1, "나래"): "고나래", (2, "한긴동"): "한긴동"}
    assert names.star_clusters(df.limit(0)).count() == 0


def test_signatures_of_a_batch_are_those_of_each_name():
    some = [("황", "용", "팔"), ("kim", "chulsoo"), ("y", "hwang"), ("팔",)] * 3
    assert names.signatures(some, 6, 2).tolist() == [names.signature(n, 6, 2) for n in some]


def test_minhash_follows_the_collision_curve():
    a, b = ("황", "용", "팔"), ("황", "옹", "팔")
    x, y = set(names._grams(a).tolist()), set(names._grams(b).tolist())
    j = len(x & y) / len(x | y)
    hit = np.mean(np.array(names.signature(a, 2000, 1)) == np.array(names.signature(b, 2000, 1)))
    assert abs(hit - j) < 0.06


def test_links_and_stars(spark):
    persons = spark.createDataFrame([(1, "황용팔"), (1, "김용팔"), (2, "황용팔")], "block long, name string")
    mentions = spark.createDataFrame([(1, "황용팔 서기관"), (1, "용팔"), (2, "용팔"), (1, "김용필"), (3, "황용팔"), (1, ""), (1, "공석")], "block long, name string")
    got = {(r.block, r.mention, r.person) for r in names.stars(names.links(mentions, persons)).collect()}
    assert got == {(1, "황용팔 서기관", "황용팔"), (2, "용팔", "황용팔"), (1, "김용필", "김용팔")}


def _lexicon(words):
    return tokens.Lexicon.build(words, tokens.ranks(tokens.vocabulary_file()))


def test_tokens_agree_with_the_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(3)
    pool = ["'", "s", "'s", "'t", "'re", "ll", "'ll", " ", "  ", "\n", "\t", " ", "가", "나다", "1", "²", ".", "!!", "<|endoftext|>", "é", "​", "\U0001f600", "a" * 70, "xyzw" * 40, "人"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", None]
    lex = _lexicon([b" ", b"\n", "가".encode(), b"s", b" s", b"ss"])
    points, offs = tokens.code_points(pa.array(texts))
    ids, ends = tokens.encode(points, offs, lex, tokens.ranks(tokens.vocabulary_file()), {})
    want = [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want


def test_lexicon_is_minimal_and_exact():
    words = [b"tap", b"taps", b"top", b"tops", b"stop", b"stops", "가나".encode()]
    lex = _lexicon(words)
    data = b"".join([*words, b"to", b"xx", b"tapx"])
    ends = np.cumsum([*map(len, words), 2, 2, 4])
    got = lex.numbers(np.frombuffer(data, np.uint8), ends - np.diff(ends, prepend=0), ends)
    assert got[: len(words)].tolist() == [sorted(words).index(w) for w in words] and got[len(words) :].tolist() == [-1, -1, -1]
    assert len(lex.final) < sum(map(len, words)) // 2  # shared suffixes


def test_token_frame(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "a b")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.token_ids(df).collect()}
    assert got[2] == got[3] == [] and got[1] == got[4] == tokens.merge(b"a", tokens.ranks(tokens.vocabulary_file())) + tokens.merge(b" b", tokens.ranks(tokens.vocabulary_file()))
    assert tokens.token_ids(df.limit(0)).count() == 0


def _folded(text, digits):
    s = unicodedata.normalize("NFKC", text or "").casefold()
    return "".join(c for c in s if (c.isalnum() if digits else c.isalpha()))


def _brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        s = _folded(t, True)
        for i, x in items:
            y = _folded(x, True)
            if any(y[j : j + 70] in s for j in range(len(y) - 69)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé가나다라12") for _ in range(rng.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(60))) for i in range(20)] + [(98, "short"), (99, None), (97, "a" * 200)]
    docs = [(0, None), (1, ""), (2, "x" * 50_000), (3, "A" * 80)]
    for d in range(4, 80):
        t = items[rng.randrange(20)][1]
        a, n = rng.randrange(60), rng.choice([40, 75, 95, 140, 400])
        part = t[a : a + n]
        if d % 3 == 0:
            part = part.upper().replace("É", "É").replace(" ", "--​ ")
        docs.append((d, " ".join(word() for _ in range(rng.randint(0, 300))) + " " + part + " " + word()))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(a, b, "가나") for a, b in items], "item_id long, text string, answer string")
    rows = leakage.leaks(spark, d, i).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    want = _brute_leaks(docs, items)
    assert got == want and len(rows) == len(got) and len(want) > 20
    assert leakage.leaks(spark, d, i.limit(0)).count() == 0 == leakage.leaks(spark, d.limit(0), i).count()


def test_wand_gives_all_above_threshold():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc") for _ in range(150)) + "common tail of all items, long enough to be shared by each and every one" for _ in range(60)]
    ix = leakage.build_index(list(range(60)), texts, [""] * 60)
    for _ in range(30):
        q = Counter(rng.randrange(len(ix.terms)) for _ in range(60))
        score = np.zeros(60)
        for t, n in q.items():
            for p in range(ix.at[t], ix.at[t + 1]):
                score[ix.items[p]] += n * ix.weights[p]
        ix.threshold = np.full(60, 8.0)
        assert sorted(leakage.wand(ix, q)) == np.flatnonzero(score >= 8.0).tolist()


def _brute_repeated(text):
    s = _folded(text, False)
    seen, hit = set(), [False] * len(s)
    for i in range(len(s) - 24):
        w = s[i : i + 25]
        if w in seen:
            hit[i : i + 25] = [True] * 25
        seen.add(w)
    return len(s), sum(hit)


def test_repetition_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "12 34", "a" * 24, "a" * 26, "ab" * 5000]
    for _ in range(60):
        t = "".join(rng.choice("가나다ab ") for _ in range(rng.randint(0, 200)))
        texts.append(t + str(rng.random()) + t[: rng.randint(0, 80)] * rng.randint(0, 3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.letters, r.repeated) for r in repetition.repetition(df, "doc_id", "text").collect()}
    assert got == {i: _brute_repeated(t) for i, t in enumerate(texts)}
    assert repetition.repetition(df.limit(0), "doc_id", "text").count() == 0


def test_host_lines(spark):
    rows = [(i, "h", f"same line 12\nown text {'abcdefghij'[i % 10] * (i + 1)}") for i in range(40)] + [(100, "h", "same line 7"), (101, "g", "same line 7"), (102, None, None), (103, "h", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.id: r for r in repetition.host_lines(df, "doc_id", "source", "text", most=20, most_share=0.05).collect()}
    assert got[100].rejected and got[100].removed == 1 and not got[101].rejected and got[102].lines == 0 and len(got) == 44


def test_held_letters_against_substrings():
    """Letters held in common runs, against a search for every window; periodic texts of any length take no longer."""
    rng = random.Random(4)
    as_points = lambda t: np.array([ord(c) for c in t], np.uint32)
    for _ in range(60):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(60, 300)))
        text = "".join(rng.choice("abc") for _ in range(50))
        for _ in range(rng.randint(0, 4)):
            a = rng.randrange(len(item))
            text += item[a : a + rng.randint(60, 150)] + rng.choice(["x", "", "abc"])
        want = {k for j in range(len(item) - leakage.RUN + 1) if item[j : j + leakage.RUN] in text for k in range(j, j + leakage.RUN)}
        t = as_points(text)
        h = window_hash(t, leakage.RUN)
        assert leakage.held_letters(as_points(item), t, h, np.argsort(h, kind="stable")) == len(want)
    t = as_points("ab" * 200_000)
    h = window_hash(t, leakage.RUN)
    assert leakage.held_letters(t[:100_000], t, h, np.argsort(h, kind="stable")) == 100_000


def test_window_hash_is_place_free():
    p, _ = letters(["abcabcabc"])
    h = window_hash(p, 3)
    assert h[0] == h[3] == h[6] and len(set(h.tolist())) == 3


def test_shared_lines_of_small_and_large_hosts(spark, tmp_path):
    rows = [(f"{n}", i, "shared line" if i % 10 == 0 else f"own {'abcdefghij'[i % 10] * (i + 1)}") for n in (30, 300) for i in range(n)]
    spark.createDataFrame([(k, h, t) for k, (h, _, t) in enumerate(rows)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in queries.QUERIES["p9_host_lines"](spark, str(tmp_path)).where("removed > 0").collect()}
    assert got == {k for k, (_, i, _) in enumerate(rows) if i % 10 == 0}


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_shared_lines_are_removed_on_the_real_tables(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE["p9_host_lines"]).fetchall()
    got = queries.QUERIES["p9_host_lines"](spark, SF).select("doc_id", "lines", "removed", "chars", "chars_left", "rejected").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.removed for r in got) > 0
