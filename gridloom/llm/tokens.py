"""Problem 7: token ids of the whole corpus by a public byte-level BPE vocabulary.

1. Texts are parted into words as the vocabulary's pattern says, by array operations over the code points of a chunk.
2. A first pass counts the words of all texts; frequent words are merged once and compiled into a minimal acyclic
   transducer: states with the same rest are shared, and numbers on its arcs add up to a word's place in the list of id
   outputs. It is written to the shared folder and mapped into memory by every worker.
3. In the second pass the distinct words of a chunk walk the automaton all at once, one byte a step; the words it
   doesn't hold are merged exactly, so the lexicon changes the speed and never an id.

Defined results: null and empty texts have an empty list; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.letters import CHUNK, prefix_hash, span_hash
from gridloom.functions.plainpoints import code_points
from gridloom.session import delete_on_exit, shared_dir, table

#: The most words of the lexicon, the longest of them in bytes, and the least times a word must occur to be in it.
WORDS, LONGEST, OFTEN = 65_536, 48, 4
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# What the vocabulary's pattern counts as white space, and its contractions.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public vocabulary is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    out[0xAC00:0xD7A4] = out[0x4E00:0xA000] = out[0x20000:0x2A6E0] = LETTER
    for a, b in ((0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0x20000), (0x2A6E0, 0x32400)):
        for c in range(a, b):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                out[c] = LETTER
            elif k == "N":
                out[c] = NUMBER
    out[list(WHITE)] = SPACE
    return out


def word_starts(p: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The places where words start; `offs` are the texts' offsets. Words tile the texts without gap."""
    n = len(p)
    if not n:
        return np.zeros(0, np.int64)
    c = _classes()[p]
    first = np.zeros(n + 1, bool)
    first[offs] = True  # a text's first character; the place after the last one too
    first_c, last_c = first[:n], first[1:]
    prev = np.concatenate([[255], c[:-1]])
    run = first_c | (c != prev)
    blank_before = np.concatenate([[False], p[:-1] == 0x20]) & ~first_c
    # Runs of letters, of numbers, of others start a word, unless the blank before it does.
    start = run & (c != SPACE) & ~blank_before
    # White space: the run's start; and its last character, if something follows in the text.
    nxt_other = np.concatenate([c[1:] != SPACE, [True]]) & ~last_c
    start |= (c == SPACE) & (run | nxt_other)
    # Contractions: a lone apostrophe that starts a word, with the letters after it.
    quote = np.flatnonzero((p == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~first_c[quote + 1] & (c[quote + 1] == LETTER)]
    if len(quote):
        for text in CONTRACTIONS:
            end = quote + 1 + len(text)
            ok = end <= n
            for i, ch in enumerate(text):
                at = np.minimum(quote + 1 + i, n - 1)
                ok &= (p[at] == ord(ch)) & ~first_c[at]
            hit, end = quote[ok], end[ok]
            start[hit + 1] = False
            inside = end < n
            rest = end[inside]
            rest = rest[(c[rest] == LETTER) & ~first_c[rest]]
            start[rest] = True
    return np.flatnonzero(start)


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one word: the lowest-ranked neighbouring pair is merged, leftmost first, until none is left."""
    if (whole := rank.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) <= 64:
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[x] for x in parts]
    # Long words: a heap of pairs over a linked list.
    n = len(parts)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if parts[i] else -1
        if j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, b""
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y >= 0 and (r := rank.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [rank[x] for x in parts if x]


class Lexicon:
    """A minimal acyclic transducer from words to lists of ids, in flat arrays.

    arcs: state * 256 + byte, ascending; to: target states; add: number of words passed over by taking the arc;
    final: whether a word ends in the state (it comes before all that go on); at, ids: the outputs by word number.
    """

    NAMES = ("arcs", "to", "add", "final", "at", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: list[bytes], rank: dict[bytes, int]) -> Lexicon:
        """Incremental construction from sorted words: a state is frozen once no later word can change it."""
        words = sorted(set(words) - {b""})
        register: dict[tuple, int] = {}
        frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, []]]  # [final, [(byte, frozen state)]] of the states along the last word
        previous = b""

        def freeze(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(frozen)
                    frozen.append(key)
                path[-1][1].append((previous[len(path) - 1], state))

        for w in words:
            common = 0
            while common < min(len(w), len(previous)) and w[common] == previous[common]:
                common += 1
            freeze(common)
            path.extend([False, []] for _ in range(len(w) - common))
            path[-1][0] = True
            previous = w
        freeze(0)
        frozen.append((path[0][0], tuple(path[0][1])))
        count: list[int] = []  # words below each state; targets are frozen before their sources
        for final, arcs in frozen:
            count.append(int(final) + sum(count[t] for _, t in arcs))
        root = len(frozen) - 1  # becomes state 0
        name = lambda s: root - s
        rows = []
        for s, (final, arcs) in enumerate(frozen):
            passed = int(final)
            for byte, t in arcs:
                rows.append((name(s) * 256 + byte, name(t), passed))
                passed += count[t]
        rows.sort()
        out = [merge(w, rank) for w in words]
        arrays = {
            "arcs": np.array([r[0] for r in rows], np.int64),
            "to": np.array([r[1] for r in rows], np.int32),
            "add": np.array([r[2] for r in rows], np.int32),
            "final": np.array([f for f, _ in reversed(frozen)], bool),
            "at": np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64),
            "ids": np.array([i for x in out for i in x], np.int32),
        }
        return cls(arrays)

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Word numbers of the words data[start:end] (bytes), -1 where the lexicon doesn't hold one; all walk at once."""
        n = len(start)
        number = np.zeros(n, np.int64)
        state = np.zeros(n, np.int64)
        alive = np.flatnonzero((end - start <= LONGEST) & (end > start))
        number[(end - start > LONGEST) | (end <= start)] = -1
        if not len(self.arcs):
            return np.full(n, -1, np.int64)
        step = 0
        while len(alive):
            key = state[alive] * 256 + data[start[alive] + step]
            k = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            ok = self.arcs[k] == key
            number[alive[~ok]] = -1
            alive, k = alive[ok], k[ok]
            number[alive] += self.add[k]
            state[alive] = self.to[k]
            step += 1
            done = end[alive] - start[alive] == step
            ended = alive[done]
            number[ended[~self.final[state[ended]]]] = -1
            alive = alive[~done]
        return number


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, offsets) of pieces of about CHUNK characters."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    piece = np.cumsum(size) // (2 * CHUNK)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(piece, piece[at], side="right")))
        points, offs = code_points(column.slice(at, end - at))
        yield at, end, points, offs
        at = end


def distinct_words(points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts of all words, number of each word among the distinct ones, a start and an end of each distinct one)."""
    start = word_starts(points, offs)
    if not len(start):
        return start, start, start, start
    end = np.concatenate([start[1:], [len(points)]])
    h = prefix_hash(points)
    key = span_hash(h, start, end) ^ (end - start).astype(np.uint64)
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    # Words of one hash are compared with its first word; any that differ count as words of their own.
    lens, rep = end - start, start[first][number]
    wrong = lens != (end[first] - start[first])[number]
    same = np.repeat(rep - start, np.where(wrong, 0, lens))
    at = np.repeat(start - np.concatenate([[0], np.cumsum(np.where(wrong, 0, lens))[:-1]]), np.where(wrong, 0, lens)) + np.arange(len(same))
    bad = points[at] != points[at + same]
    if bad.any():
        wrong |= np.isin(np.arange(len(start)), np.searchsorted(start, at[bad], side="right") - 1)
    if wrong.any():
        own = np.flatnonzero(wrong)
        number = number.copy()
        number[own] = len(first) + np.arange(len(own))
        first = np.concatenate([first, own])
    return start, number, start[first], end[first]


def _utf8(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of the spans one after another, with each span's start and end."""
    lens = end - start
    at = np.repeat(start - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
    p = points[at]
    raw = np.frombuffer(p.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    width = 1 + (p > 0x7F).astype(np.int64) + (p > 0x7FF) + (p > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(lens)])]
    return raw, ends[:-1], ends[1:]


def word_counts(corpus: DataFrame) -> DataFrame:
    """word (binary), n: how often each word occurs in all texts; a task gives each of its words once a batch of texts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = list(total)
            b = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])
            total.clear()
            return b

        for b in batches:
            for _, _, points, offs in _pieces(b.column(0)):
                _, number, s, e = distinct_words(points, offs)
                if not len(s):
                    continue
                raw, a, z = _utf8(points, s, e)
                data, n = raw.tobytes(), np.bincount(number, minlength=len(s))
                for i, j, k in zip(a.tolist(), z.tolist(), n.tolist()):
                    if j - i <= LONGEST:
                        total[data[i:j]] += k
            if len(total) > 300_000:
                yield out()
        if total:
            yield out()

    return corpus.select(F.col("text").cast("string")).where("text is not null").mapInArrow(kernel, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_lexicon(corpus: DataFrame, vocabulary: str) -> Lexicon:
    """The lexicon of the most frequent words: at most WORDS of at most LONGEST bytes come to the driver."""
    rows = word_counts(corpus).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "word").limit(WORDS).select("word").toArrow()
    return Lexicon.build(rows.column(0).to_pylist(), ranks(vocabulary))


class _Mapped:
    """A lexicon in the shared folder, mapped into memory where that is a file system of the machine; else broadcast (it has a bound)."""

    def __init__(self, spark: SparkSession, lexicon: Lexicon):
        at = shared_dir(spark)
        self.sent = self.path = None
        if at.startswith("file:") or at.startswith("/"):
            import os

            self.path = at.removeprefix("file:")
            self.path = "/" + self.path.lstrip("/") + f"/lexicon-{uuid.uuid4().hex}"
            os.makedirs(self.path, exist_ok=True)
            for name in Lexicon.NAMES:
                np.save(f"{self.path}/{name}.npy", getattr(lexicon, name))
            delete_on_exit(spark, f"file://{self.path}")
        else:
            self.sent = spark.sparkContext.broadcast({n: getattr(lexicon, n) for n in Lexicon.NAMES})

    def load(self) -> Lexicon:
        if self.path is None:
            return Lexicon(self.sent.value)
        return Lexicon({n: np.load(f"{self.path}/{n}.npy", mmap_mode="r") for n in Lexicon.NAMES})


def encode(points: np.ndarray, offs: np.ndarray, lexicon: Lexicon, rank: dict[bytes, int], memo: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, offsets)."""
    start, number, s, e = distinct_words(points, offs)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
    raw, a, z = _utf8(points, s, e)
    known = lexicon.numbers(raw, a, z)
    unseen = np.flatnonzero(known < 0)
    own: list[list[int]] = []
    for i in unseen.tolist():
        w = raw[a[i] : z[i]].tobytes()
        got = memo.get(w)
        if got is None:
            got = merge(w, rank)
            if len(w) <= 64:
                if len(memo) > 100_000:
                    memo.clear()
                memo[w] = got
        own.append(got)
    # One table of outputs: the lexicon's, then those of the unseen words.
    known = known.copy()
    known[unseen] = len(lexicon.at) - 1 + np.arange(len(unseen))
    lens = np.array([len(x) for x in own], np.int64)
    at = np.concatenate([lexicon.at, lexicon.at[-1] + np.cumsum(lens)])
    ids = np.concatenate([lexicon.ids, np.array([i for x in own for i in x], np.int32)])
    word = known[number]
    n = (at[1:] - at[:-1])[word]
    ends = np.cumsum(n)
    take = np.repeat(at[word] - (ends - n), n) + np.arange(int(ends[-1]))
    total = np.concatenate([[0], ends])
    return ids[take], total[np.searchsorted(start, offs)]


def token_ids(corpus: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids of every row of `corpus` (doc_id, text); `vocabulary` is the path of a rank file."""
    vocabulary = vocabulary or vocabulary_file()
    corpus = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mapped = _Mapped(corpus.sparkSession, frequent_lexicon(corpus.select("text"), vocabulary))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, rank, memo = mapped.load(), ranks(vocabulary), {}
        for b in batches:
            for at, end, points, offs in _pieces(b.column(1)):
                ids, ends = encode(points, offs, lexicon, rank, memo)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), lists], names=["doc_id", "ids"])

    return corpus.mapInArrow(kernel, "doc_id long, ids array<int>")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))
