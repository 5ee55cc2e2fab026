"""Problem 8: evaluation texts that turn up, whole or in part, in training texts.

The test items go into a BM25 inverted index over windows of TERM letters and digits, with the largest weight of every
block of postings. Every training text is cut into overlapping passages, so that any run of RUN letters lies whole in
one of them, and every passage is a query: windows that are in the index at all are found by one gather for a whole
chunk of texts; passages whose summed largest weights can't reach the lowest threshold are passed over (the upper bound
of WAND); the others are searched by block-max WAND, which gives all items above threshold. An item's threshold is the
score that RUN shared letters must reach at least, (RUN - TERM + 1) times its smallest weight, so nothing is lost. What
is retrieved is verified on the letters themselves, and the answer is looked for in the same text.

The index is broadcast: its size is checked, and items beyond the limit go into further indexes that the texts are read
against one after another. Defined results: null and empty texts and items with fewer than RUN letters give no rows;
copies under another id each give theirs; texts of any length are read whole.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.letters import chunks, letters, window_hash, window_owner
from gridloom.session import table

RUN, TERM, BLOCK = 70, 24, 16
PASSAGE = 400
#: Characters of items in one broadcast index; at 24 bytes and more a character about 100 MB.
MOST = 3_000_000
K1, B = 1.2, 0.75
BITS = 20


@dataclass
class Index:
    """BM25 postings: `terms` ascending; the postings of terms[i] are items[at[i]:at[i + 1]], ascending, with their weights."""

    ids: np.ndarray
    texts: list[np.ndarray]
    answers: list[str]
    terms: np.ndarray
    at: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    block_at: np.ndarray
    block_last: np.ndarray
    block_max: np.ndarray
    term_max: np.ndarray
    threshold: np.ndarray
    bitmap: np.ndarray


def build_index(ids: list[int], texts: list[str | None], answers: list[str | None]) -> Index | None:
    """The index of the items long enough to be found."""
    points, offs = letters(texts)
    ans, ans_offs = letters(answers)
    lens = offs[1:] - offs[:-1]
    use = np.flatnonzero(lens >= RUN)
    if not len(use):
        return None
    place, owner = window_owner(offs, TERM)
    keep = lens[owner] >= RUN
    place, owner = place[keep], owner[keep]
    h = window_hash(points, TERM)[place]
    number = np.zeros(len(ids), np.int64)
    number[use] = np.arange(len(use))
    order = np.lexsort((owner, h))
    h, owner = h[order], number[owner[order]]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    tf = np.diff(np.concatenate([first, [len(h)]]))
    h, owner = h[first], owner[first]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    at = np.concatenate([start, [len(h)]])
    df = np.diff(at)
    n = len(use)
    idf = np.repeat(np.log(1 + (n - df + 0.5) / (df + 0.5)), df)
    size = (lens[use] - TERM + 1).astype(float)
    weights = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / size.mean()))
    least = np.full(n, np.inf)
    np.minimum.at(least, owner, weights)
    block_at, last, most = [0], [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        for i in range(a, b, BLOCK):
            last.append(int(owner[min(i + BLOCK, b) - 1]))
            most.append(float(weights[i : min(i + BLOCK, b)].max()))
        block_at.append(len(last))
    bitmap = np.zeros(1 << BITS, bool)
    terms = h[start]
    bitmap[(terms >> np.uint64(64 - BITS)).astype(np.int64)] = True
    text = lambda p, o, i: p[o[i] : o[i + 1]].tobytes().decode("utf-32-le", "surrogatepass")
    return Index(np.array(ids, np.int64)[use], [points[offs[i] : offs[i + 1]] for i in use], [text(ans, ans_offs, i) for i in use], terms, at, owner.astype(np.int32), weights, np.array(block_at), np.array(last), np.array(most), np.maximum.reduceat(weights, start), (RUN - TERM + 1) * least * (1 - 1e-9), bitmap)


def wand(index: Index, query: Counter) -> list[int]:
    """All items whose score for the query (term number -> occurrences) reaches their threshold, by block-max WAND."""
    low = float(index.threshold.min())
    # A cursor: [item, posting, end, weight of the query, upper bound, term]
    cursors = []
    for term, times in query.items():
        a, b = int(index.at[term]), int(index.at[term + 1])
        cursors.append([int(index.items[a]), a, b, times, times * float(index.term_max[term]), term])
    done = len(index.ids)

    def move(c: list, to: int) -> None:
        c[1] = a = c[1] + int(np.searchsorted(index.items[c[1] : c[2]], to))
        c[0] = int(index.items[a]) if a < c[2] else done

    def block(c: list, item: int) -> tuple[float, int]:
        """Largest weight of the block that would hold the item, and the last item of the block."""
        a, b = int(index.block_at[c[5]]), int(index.block_at[c[5] + 1])
        i = bisect_left(index.block_last, item, a, b)
        return (c[3] * float(index.block_max[i]), int(index.block_last[i])) if i < b else (0.0, done)

    out = []
    while True:
        cursors = [c for c in cursors if c[0] < done]
        cursors.sort(key=lambda c: c[0])
        total, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            total += c[4]
            if total >= low:
                pivot = i
                break
        if pivot < 0:
            return out
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        bounds = [block(c, item) for c in cursors[: pivot + 1]]
        if sum(x for x, _ in bounds) < low:  # no item up to the end of the shortest block can reach it
            to = min(x for _, x in bounds) + 1
            if pivot + 1 < len(cursors):
                to = min(to, cursors[pivot + 1][0])
            for c in cursors[: pivot + 1]:
                if c[0] < to:
                    move(c, max(to, item + 1) if to <= item else to)
            continue
        if cursors[0][0] == item:
            score = sum(c[3] * float(index.weights[c[1]]) for c in cursors[: pivot + 1])
            if score >= index.threshold[item]:
                out.append(item)
            for c in cursors[: pivot + 1]:
                move(c, item + 1)
        else:
            for c in cursors[: pivot + 1]:
                if c[0] < item:
                    move(c, item)


def search(index: Index, points: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, float]]:
    """(text, item, share of the item's letters that the text holds in runs of RUN) of all leaks of a chunk of texts."""
    place, owner = window_owner(offs, TERM)
    if not len(place):
        return []
    h = window_hash(points, TERM)
    maybe = np.flatnonzero(index.bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)])
    k = np.minimum(np.searchsorted(index.terms, h[maybe]), len(index.terms) - 1)
    hit = index.terms[k] == h[maybe]
    at, term = maybe[hit], k[hit]
    text = np.searchsorted(offs, at, side="right") - 1
    inside = at + TERM <= offs[text + 1]
    at, term, text = at[inside], term[inside], text[inside]
    if not len(at):
        return []
    # Passages start every STEP letters; a window lies in the one its start is in and, if it fits, in the one before.
    step = PASSAGE - RUN + 1
    local = at - offs[text]
    own = local // step
    both = (own > 0) & (local + TERM <= (own - 1) * step + PASSAGE)
    passage = np.concatenate([own, own[both] - 1])
    t2, term2 = np.concatenate([text, text[both]]), np.concatenate([term, term[both]])
    order = np.lexsort((passage, t2))
    passage, t2, term2 = passage[order], t2[order], term2[order]
    start = np.flatnonzero(np.concatenate([[True], (passage[1:] != passage[:-1]) | (t2[1:] != t2[:-1])]))
    end = np.concatenate([start[1:], [len(passage)]])
    bound = np.add.reduceat(index.term_max[term2], start)
    low = index.threshold.min()
    found: dict[tuple[int, int], None] = {}
    for a, b in zip(start[bound >= low].tolist(), end[bound >= low].tolist()):
        for item in wand(index, Counter(term2[a:b].tolist())):
            found[int(t2[a]), item] = None
    out = []
    last, hashes = -1, np.zeros(0, np.uint64)
    for i, item in sorted(found):
        text = points[offs[i] : offs[i + 1]]
        if i != last:
            last, hashes = i, window_hash(text, RUN)
            order = np.argsort(hashes, kind="stable")
        if held := held_letters(index.texts[item], text, hashes, order):
            out.append((i, item, held / len(index.texts[item])))
    return out


def held_letters(target: np.ndarray, text: np.ndarray, hashes: np.ndarray, order: np.ndarray) -> int:
    """How many letters of target lie in runs of RUN that text holds too; hashes: of text's windows, order: sorts them.

    Windows meet by hash, and those that do are compared letter by letter.
    """
    own = window_hash(target, RUN)
    if not len(own) or not len(hashes):
        return 0
    ordered = hashes[order]
    at = np.minimum(np.searchsorted(ordered, own), len(ordered) - 1)
    hits = np.flatnonzero(ordered[at] == own)
    steps, same = np.arange(RUN), np.zeros(len(hits), bool)
    for k in range(0, len(hits), 20_000):
        part = hits[k : k + 20_000]
        same[k : k + 20_000] = (target[part[:, None] + steps] == text[order[at[part]][:, None] + steps]).all(axis=1)
    for k in np.flatnonzero(~same).tolist():  # two windows of one hash: another one of it may be the same
        j = int(hits[k])
        b = int(at[j])
        while b < len(ordered) and ordered[b] == own[j] and not same[k]:
            same[k] = bool((text[order[b] : order[b] + RUN] == target[j : j + RUN]).all())
            b += 1
    starts = hits[same]
    if not len(starts):
        return 0
    return int(np.minimum(np.diff(starts), RUN).sum() + RUN)


def leaks(spark: SparkSession, corpus: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, held_share, answer_held: every text of `corpus` (doc_id, text) with the items (item_id, text, answer) it holds."""
    numbered = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.col("answer").cast("string").alias("answer"))
    sizes = numbered.agg(F.sum(F.length("text") + 1).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(sizes / MOST))
    corpus = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, held_share double, answer_held boolean"

    def against(part: int) -> DataFrame:
        rows = numbered.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()  # at most about MOST characters
        index = build_index([r.item_id for r in rows], [r.text for r in rows], [r.answer for r in rows])
        sent = spark.sparkContext.broadcast(index)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                for at, _, texts in chunks(b) if index else ():
                    points, offs = letters(texts)
                    got = search(index, points, offs)
                    if not got:
                        continue
                    ids = b.column(0)
                    answer = [bool(index.answers[k]) and index.answers[k] in points[offs[i] : offs[i + 1]].tobytes().decode("utf-32-le", "surrogatepass") for i, k, _ in got]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[at + i].as_py() for i, _, _ in got], pa.int64()), pa.array([int(index.ids[k]) for _, k, _ in got], pa.int64()), pa.array([s for _, _, s in got]), pa.array(answer)], names=["doc_id", "item_id", "held_share", "answer_held"])

        return corpus.mapInArrow(kernel, schema)

    return reduce(DataFrame.unionAll, (against(p) for p in range(parts)))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")
