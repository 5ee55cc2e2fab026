"""Problem 4: variant spellings of names, linked to the listed person they mean.

Mentions and persons are compared within a block (the department), each distinct spelling once. Every person is written
in the forms in which people write names (in full, given name, parts left out, pet form, family name alone, romanised in
either order, syllables together or apart, initials); mentions lose titles, remarks and invisible characters. MinHash
over padded q-grams of each part (the letters of a Hangul syllable, the letters of a Latin word in one spelling), in
bands whose number and length come from the collision curve, gives candidate pairs by an equality join on (block, band,
hash); Monge-Elkan similarity of the parts verifies them. Star clustering takes the listed persons as its first centres:
each mention goes to its most similar centre, to none if two are as similar. The mentions left are clustered into stars
among themselves (p4_clusters): of those not yet in a star the one with most neighbours is a centre.

Defined results: null, empty and title-only mentions mean nobody; a mention in a block without persons has no row; equal
mentions of a block are compared once and each keep their row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.plainform import plain_form
from gridloom.functions.plainpoints import plain_array
from gridloom.llm.canonical import department_names, mapping, owner_texts
from gridloom.operators.packed import packed_values
from gridloom.session import cut, lookup, parallel, table

# Romanisation of the Hangul letters, customary spellings of family names, titles.
LEADS = ("g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h")
VOWELS = ("a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i")
TAILS = ("", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t")
FAMILY = {
    "김": ("kim", "gim"), "이": ("lee", "yi", "rhee"), "박": ("park", "pak", "bak"), "최": ("choi", "choe"), "정": ("jeong", "jung", "chung"), "강": ("kang", "gang"),
    "조": ("cho", "jo"), "윤": ("yun", "yoon"), "장": ("jang", "chang"), "임": ("lim", "im"), "한": ("han",), "오": ("oh", "o"), "서": ("seo", "suh"), "신": ("shin", "sin"),
    "권": ("kwon", "gwon"), "황": ("hwang",), "안": ("ahn", "an"), "송": ("song",), "류": ("ryu", "ryoo", "yu"), "유": ("yu", "yoo"), "홍": ("hong",), "전": ("jeon", "jun"), "고": ("ko", "go"), "문": ("moon", "mun"), "양": ("yang",), "손": ("son", "sohn"), "배": ("bae",), "백": ("baek", "paik"), "허": ("heo", "hur"), "남": ("nam",), "심": ("sim", "shim"), "노": ("noh", "roh"), "하": ("ha",), "곽": ("kwak",), "성": ("sung", "seong"), "차": ("cha",), "주": ("joo", "ju"), "우": ("woo", "u"), "구": ("koo", "gu"), "민": ("min",), "나": ("na",), "진": ("jin",), "지": ("ji",), "엄": ("um", "eom"), "원": ("won",), "천": ("cheon",), "방": ("bang",), "공": ("kong", "gong"),
}
TITLES = "행정사무관|시설사무관|행정서기관|행정주사보|시설주사보|행정주사|시설주사|담당자|사무관|서기관|주무관|주사보|담당관|주사|팀장|과장|국장|실장|계장|차장|부장|담당|님|씨"
_TITLE = re.compile(f"(?:^|(?<=[\\s가-힣]))(?:{TITLES})(?=$|\\s)|^(?:{TITLES})(?=\\s)")
_REMARK = re.compile(r"\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]")
_MARKS = re.compile(r"[\"'“”‘’「」『』*?!,;:/|()\[\]]")

# Family names of two syllables.
LONG_FAMILY = ("남궁", "황보", "제갈", "사공", "선우", "서문", "독고", "동방")
# Spellings of the same sound in romanised names, in the order in which they are replaced.
SPELLINGS = (("oo", "u"), ("ou", "u"), ("eo", "u"), ("eu", "u"), ("woo", "u"), ("ee", "i"), ("yi", "i"), ("ae", "e"), ("oe", "e"), ("ch", "j"), ("sh", "s"), ("rh", "r"), ("g", "k"), ("d", "t"), ("b", "p"), ("l", "r"))

#: Pairs as alike as LIKE must become candidates with a chance of RECALL at least: one wrong letter leaves the q-grams of
#: a name of two syllables 0.6 alike, longer names more, and all other forms are compared as they are.
LIKE, RECALL, ROWS = 0.5, 0.999, 64
#: Parts of a spelling as one text.
APART = "\x1f"


def bands(like: float = LIKE, recall: float = RECALL, most: int = ROWS) -> tuple[int, int]:
    """(bands, rows a band): the longest bands whose collision curve 1 - (1 - s^r)^b reaches the recall at s = like within `most` hashes."""
    for r in range(8, 0, -1):
        b = math.ceil(math.log(1 - recall) / math.log(1 - like**r))
        if b * r <= most:
            return b, r
    return most, 1


@lru_cache(maxsize=50_000)
def parts(name: str | None) -> tuple[str, ...]:
    """The parts of a name as typed: Hangul syllables, or lower-case Latin words and initials; without titles and remarks."""
    text = plain_form(name) or ""
    text = _REMARK.sub(" ", text).strip()
    text = _MARKS.sub(" ", text)
    while (less := _TITLE.sub(" ", text.strip())) != text.strip():
        text = less
    text = text.strip()
    hangul = [c for c in text if "가" <= c <= "힣"]
    if hangul:
        return tuple(hangul)
    return tuple(x for x in re.split(r"[\s.,]+", text.replace("-", "").lower()) if x.isalpha())


def roman(syllable: str) -> str:
    i = ord(syllable) - 0xAC00
    return LEADS[i // 588] + VOWELS[i % 588 // 28] + TAILS[i % 28]


@lru_cache(maxsize=50_000)
def forms(name: tuple[str, ...]) -> list[tuple[float, tuple[str, ...]]]:
    """(weight, parts) of the forms in which a listed person may be written; 1 for the whole name."""
    out: list[tuple[float, tuple[str, ...]]] = [(1.0, name)]
    if len(name) < 2 or not all("가" <= c <= "힣" for c in name):
        return out
    family, given = (name[:2], name[2:]) if len(name) == 4 or len(name) == 3 and "".join(name[:2]) in LONG_FAMILY else (name[:1], name[1:])
    if not given:
        return out
    last = given[-1]
    out.append((0.95, given))
    out.append((0.9, (last, "이" if (ord(last) - 0xAC00) % 28 else "야")))
    if len(given) > 1:
        out += [(0.85, (*family, g)) for g in given]
    out.append((0.8, family))
    spelled = "".join(map(roman, given))
    initials = tuple(roman(g)[0] for g in given)
    for f in FAMILY.get("".join(family), ("".join(map(roman, family)),)):
        out += [(1.0, (spelled, f)), (1.0, (*map(roman, given), f)), (0.9, (initials[0], f)), (0.9, (f, *initials)), (0.9, (f, "".join(initials)))]
    return out


@lru_cache(maxsize=50_000)
def sound(word: str) -> str:
    """A romanised word in one spelling of its sounds."""
    for a, b in SPELLINGS:
        word = word.replace(a, b)
    return re.sub(r"(.)\1", r"\1", word)


def _letters(part: str) -> str:
    """A syllable's letters; a word as it sounds (initials as they are)."""
    if len(part) == 1 and "가" <= part <= "힣":
        i = ord(part) - 0xAC00
        return chr(0x1100 + i // 588) + chr(0x1161 + i % 588 // 28) + (chr(0x11A7 + i % 28))
    return sound(part) if len(part) > 1 else part


@lru_cache(maxsize=200_000)
def _like(a: str, b: str) -> float:
    """Similarity of two parts: shared letters of two syllables, or 1 - edits / length of two words."""
    if a == b:
        return 1.0
    x, y = (_letters(a), _letters(b)) if len(a) == len(b) == 1 else (a, b)
    if len(x) == len(y) == 3 and len(a) == len(b) == 1:
        return sum(p == q for p, q in zip(x, y)) / 3
    if min(len(x), len(y)) < 3:
        return 0.0
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        prev, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (p != q))
    return 1 - row[-1] / max(len(x), len(y))


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """The mean best similarity of each side's parts, the lesser of both ways; a part serves as often as it occurs."""
    if not a or not b:
        return 0.0
    return min(sum(max(_like(x, y) for y in b) for x in a) / len(a), sum(max(_like(x, y) for x in a) for y in b) / len(b))


def similarity(mention: tuple[str, ...], person: tuple[str, ...]) -> float:
    """0, or how surely the mention is a form of the person's name.

    One letter may be wrong in a whole name, of whichever number of parts; the other forms count as they are or, if
    romanised, as they sound. Parts in another order weigh a little less, other spellings of a sound less again.
    """
    exact, turned, sounds, whole = _forms_by(person)
    best = exact.get(mention, 0.0)
    order = tuple(sorted(mention))
    if order in turned:
        best = max(best, turned[order])
    elif order[:1] and order[0].isascii():
        best = max(best, sounds.get(tuple(sorted(map(_letters, mention))), 0.0))
    if best >= 0.93:
        return best
    for form in whole:
        s = monge_elkan(mention, form)
        if s >= 0.88:
            best = max(best, s if s < 1 else 0.93)  # all parts there, one twice or once too few
    return best


@lru_cache(maxsize=50_000)
def _forms_by(person: tuple[str, ...]) -> tuple[dict, dict, dict, list]:
    """Weights of a person's forms: as they are, with the parts in another order, as they sound; and the whole names."""
    exact: dict[tuple[str, ...], float] = {}
    turned: dict[tuple[str, ...], float] = {}
    sounds: dict[tuple[str, ...], float] = {}
    for weight, form in forms(person):
        latin, order = form[0].isascii(), tuple(sorted(form))
        exact[form] = max(weight, exact.get(form, 0.0))
        if latin or weight == 1:
            turned[order] = max(weight if latin else 0.93, turned.get(order, 0.0))
        if latin:
            heard = tuple(sorted(map(_letters, form)))
            sounds[heard] = max(SOUND * weight, sounds.get(heard, 0.0))
    return exact, turned, sounds, [f for w, f in forms(person) if w == 1]


#: Weight of a romanised name that only sounds the same.
SOUND = 0.85


def _grams(name: tuple[str, ...], q: int = 2) -> np.ndarray:
    out = set()
    for p in name:
        x = "^" + _letters(p) + "$"
        out |= {x[i : i + q] for i in range(len(x) - q + 1)}
    return np.array([ord(g[0]) << 21 | ord(g[1]) for g in out], np.uint64)


def signatures(names: list[tuple[str, ...]], b: int, r: int) -> np.ndarray:
    """One hash for each band of the MinHash signature over the padded q-grams of each name's parts: an array of names x bands."""
    rng = np.random.default_rng(7)
    odd, add = rng.integers(1, 1 << 63, b * r, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, b * r, np.uint64)
    out = np.zeros((len(names), b), np.uint64)
    texts = ["".join(f"^{_letters(p)}$" for p in name) for name in names]
    for at in range(0, len(names), max(1, 400_000 // (b * r))):
        part = texts[at : at + max(1, 400_000 // (b * r))]
        p = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).astype(np.uint64)
        gram = np.flatnonzero(p[:-1] != ord("$"))  # no gram crosses from part to part, nor from name to name
        starts = np.searchsorted(gram, np.cumsum([0, *map(len, part[:-1])]))
        with np.errstate(over="ignore"):
            x = (p[gram] << np.uint64(21) | p[gram + 1])[:, None] * odd + add
            x ^= x >> np.uint64(29)
            x = x * np.uint64(0xBF58476D1CE4E5B9)
            least = np.minimum.reduceat(x >> np.uint64(32), starts).reshape(len(part), b, r)
            for i in range(r):
                out[at : at + len(part)] = (out[at : at + len(part)] ^ least[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
    return (out >> np.uint64(1)).astype(np.int64)


def signature(name: tuple[str, ...], b: int, r: int) -> list[int]:
    return signatures([name], b, r)[0].tolist()


def spellings(df: DataFrame) -> DataFrame:
    """block, name, spelling of the distinct (block, name) of df: the name's parts as one text; names without parts fall out."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [APART.join(parts(n)) for n in plain_array(x.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(got, pa.string())], names=["block", "name", "spelling"]).filter(pa.array([bool(g) for g in got], pa.bool_()))

    distinct = df.select(F.col("block").cast("long").alias("block"), "name").distinct()
    return distinct.repartition(parallel(df.sparkSession), "name").mapInArrow(kernel, "block long, name string, spelling string")


def banded(df: DataFrame, all_forms: bool) -> DataFrame:
    """block, spelling, band, h of the distinct (block, spelling) of df; of every form of the spelling, if told so.

    Whole names, in which a letter may be wrong, are in all bands. The other forms count only as they are, turned or as
    they sound, so their q-grams equal the mention's and one band finds them for certain.
    """
    b, r = bands()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            own = [tuple(t.split(APART)) for t in x.column(1).to_pylist()]
            each = [[(f, b if w == 1 else 1) for w, f in forms(p)] if all_forms else [(p, b)] for p in own]
            use = np.array([n for e in each for _, n in e], np.int64)
            sig = signatures([f for e in each for f, _ in e], b, r)
            row = np.repeat(np.repeat(np.arange(len(own)), [len(e) for e in each]), use)
            form = np.repeat(np.arange(len(use)), use)
            band = np.arange(len(form)) - np.repeat(np.cumsum(use) - use, use)
            kept = x.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(band.astype(np.int32)), pa.array(sig[form, band])], names=["block", "spelling", "band", "h"])

    few = df.select("block", "spelling").distinct().repartition(parallel(df.sparkSession), "spelling")
    return few.mapInArrow(kernel, "block long, spelling string, band int, h long").distinct()


def verified(pairs: DataFrame, both_ways: bool = False) -> DataFrame:
    """The distinct pairs (block, mention, person: spellings) that are alike, with their similarity."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str], float] = {}
        for x in batches:
            out = []
            for m, p in zip(x.column(1).to_pylist(), x.column(2).to_pylist()):
                if (s := memo.get((m, p))) is None:
                    a, b = tuple(m.split(APART)), tuple(p.split(APART))
                    s = memo[m, p] = max(similarity(a, b), similarity(b, a) if both_ways else 0.0)
                out.append(s)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(out, pa.float64())], names=["block", "mention", "person", "similarity"]).filter(pa.array([v > 0 for v in out], pa.bool_()))

    # By mention, so that one shuffle serves the distinct and spreads the work whatever the size of a block.
    pairs = pairs.select("block", "mention", "person").repartition(parallel(pairs.sparkSession), "block", "mention").distinct()
    return pairs.mapInArrow(kernel, "block long, mention string, person string, similarity double")


def links(mentions: DataFrame, persons: DataFrame) -> DataFrame:
    """block, mention, person, similarity of all verified pairs of names; mentions and persons: block, name."""
    m, p = cut(spellings(mentions)), cut(spellings(persons))
    found = linked(m, p).withColumnsRenamed({"mention": "m", "person": "p"})
    found = found.join(m.select("block", F.col("name").alias("mention"), F.col("spelling").alias("m")), ["block", "m"])
    return found.join(p.select("block", F.col("name").alias("person"), F.col("spelling").alias("p")), ["block", "p"]).select("block", "mention", "person", "similarity")


def linked(mentions: DataFrame, persons: DataFrame) -> DataFrame:
    """block, mention, person, similarity of all verified pairs of spellings; mentions and persons: block, spelling."""
    a = banded(mentions, False).withColumnRenamed("spelling", "mention")
    b = banded(persons, True).withColumnRenamed("spelling", "person")
    return verified(a.join(b, ["block", "band", "h"]))


def stars(found: DataFrame) -> DataFrame:
    """block, mention, person, similarity: each mention with the given centre it is most similar to, unless two are as similar."""
    most = W.partitionBy("block", "mention")
    best = found.withColumn("most", F.max("similarity").over(most)).where("similarity = most")
    return best.withColumn("n", F.count("*").over(most)).where("n = 1").select("block", "mention", "person", "similarity")


def star_clusters(names: DataFrame) -> DataFrame:
    """block, spelling, centre: stars among the spellings (block, spelling) of nobody who is listed.

    In each round a spelling is a centre if it has more neighbours than all of its neighbours that are in no star yet (of
    as many, the first by text), and those neighbours join the star of their most similar centre. A spelling left alone
    is a star of its own.
    """
    names = cut(names.select("block", "spelling").distinct())
    a = banded(names, False)
    pairs = a.withColumnRenamed("spelling", "mention").join(a.withColumnRenamed("spelling", "person"), ["block", "band", "h"]).where("mention < person")
    one = verified(pairs, both_ways=True)
    left = cut(one.unionByName(one.select("block", F.col("person").alias("mention"), F.col("mention").alias("person"), "similarity")))
    done = None
    while not left.isEmpty():
        degree = left.groupBy("block", "mention").agg(F.count("*").alias("n"))
        ranked = left.join(degree, ["block", "mention"]).join(degree.select("block", F.col("mention").alias("person"), F.col("n").alias("of")), ["block", "person"])
        before = F.max(((F.col("of") > F.col("n")) | (F.col("of") == F.col("n")) & (F.col("person") < F.col("mention"))).cast("int"))
        centres = cut(ranked.groupBy("block", "mention").agg(before.alias("b")).where("b = 0").select("block", F.col("mention").alias("centre")))
        near = left.join(centres.withColumnRenamed("centre", "person"), ["block", "person"]).groupBy("block", "mention").agg(F.max_by("person", F.struct("similarity", "person")).alias("centre"))
        new = cut(near.select("block", F.col("mention").alias("spelling"), "centre").unionAll(centres.select("block", F.col("centre").alias("spelling"), "centre")))
        done = new if done is None else done.unionAll(new)
        for end in ("mention", "person"):
            left = left.join(new.select("block", F.col("spelling").alias(end)), ["block", end], "left_anti")
        left = cut(left.select("block", "mention", "person", "similarity"))
    if done is None:
        return names.withColumn("centre", F.col("spelling"))
    return done.unionAll(names.join(done, ["block", "spelling"], "left_anti").withColumn("centre", F.col("spelling")))


def officer_mentions(spark: SparkSession, owners: DataFrame, logical: DataFrame) -> DataFrame:
    """mention_table, mention_id, pos, name, department: every mention of an officer with the department its row names."""
    of = owner_texts(spark, owners).withColumnRenamed("text", "department")
    packed = packed_values(owners, "owner_id", "officer_raw").select(F.lit("reference_owners").alias("mention_table"), F.col("row_id").alias("mention_id"), "pos", F.col("item").alias("name"))
    packed = packed.join(of.withColumnRenamed("owner_id", "mention_id"), "mention_id").select("mention_table", "mention_id", "pos", "name", "department")
    listed = logical.select(F.col("logical_id").cast("long").alias("mention_id"), "department", F.posexplode("officers").alias("p", "name"))
    listed = listed.select(F.lit("logical_tables").alias("mention_table"), "mention_id", (F.col("p") + 1).alias("pos"), "name", "department")
    return packed.unionAll(listed).where("department is not null and name is not null")


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions with their block, the distinct names of each block with their spelling, listed persons as centres)."""
    owners, logical, users, glossary = (table(spark, sf_dir, n) for n in ("reference_owners", "logical_tables", "onnara_users", "official_translation_glossary"))
    mentions = officer_mentions(spark, owners, logical)
    users = users.select(F.col("row_number").cast("long").alias("user_row"), "name", F.coalesce("department", "display_department").alias("department")).where("name is not null")
    texts = owner_texts(spark, owners).select(F.col("text").alias("department")).unionAll(logical.select("department")).unionAll(users.select("department"))
    texts = texts.where("department is not null").distinct().withColumnRenamed("department", "text")
    to = cut(mapping(spark, texts, department_names(spark, glossary)).where("entry_id > 0").select(F.col("text").alias("department"), F.col("entry_id").alias("block")))
    mentions = cut(lookup(mentions, to, ["department"], "mention_id").where("block is not null").drop("department"))
    names = cut(spellings(mentions))
    # A name listed twice in a department means no single row; it is no centre.
    listed = users.join(to, "department")
    centres = spellings(listed).join(listed, ["block", "name"]).groupBy("block", "spelling").agg(F.min("user_row").alias("user_row"), F.count("*").alias("n")).where("n = 1").drop("n")
    return mentions, names, cut(centres)


def _mentions_of(mentions: DataFrame, names: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """Each mention with what its spelling (column `on` of found) got."""
    known = cut(names.join(found.withColumnRenamed(on, "spelling"), ["block", "spelling"]).drop("spelling"))
    return lookup(mentions, known, ["block", "name"], "mention_id")


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mention_table, mention_id, pos, user_row, similarity."""
    mentions, names, centres = _prepared(spark, sf_dir)
    found = stars(linked(names, centres)).join(centres.withColumnRenamed("spelling", "person"), ["block", "person"]).drop("person")
    found = _mentions_of(mentions, names, found, "mention").where("user_row is not null")
    return found.select("mention_table", "mention_id", F.col("pos").cast("int").alias("pos"), "user_row", "similarity")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_links(spark, sf_dir).select("mention_table", "mention_id", "pos", "user_row")


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mention_table, mention_id, pos, entry_id, centre, user_row: every mention with its star in its department; user_row only if a listed person is the centre.

    Mentions as near to two listed persons, and those of nobody listed, are in stars among themselves; those without any
    part of a name are in none.
    """
    mentions, names, centres = _prepared(spark, sf_dir)
    listed = cut(stars(linked(names, centres)).join(centres.withColumnRenamed("spelling", "person"), ["block", "person"]).select("block", F.col("mention").alias("spelling"), F.col("person").alias("centre"), "user_row"))
    rest = star_clusters(names.join(listed, ["block", "spelling"], "left_anti"))
    every = listed.unionByName(rest.withColumn("user_row", F.lit(None).cast("long")))
    found = _mentions_of(mentions, names, every.withColumn("centre", F.replace("centre", F.lit(APART), F.lit(" "))), "spelling")
    return found.where("centre is not null").select("mention_table", "mention_id", F.col("pos").cast("int").alias("pos"), F.col("block").alias("entry_id"), "centre", "user_row")
