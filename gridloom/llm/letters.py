"""Letters and digits of texts as one array of code points, and hashes of all windows over them.

Case, width, composition and compatibility signs make no difference: texts are brought to NFKC and case-folded, and
then all characters but letters and digits are left out (invisible ones before composing, so that they part nothing).
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1_000_000  # characters handled at once; a longer text is a chunk of its own
_LOOSE = re.compile("[̀-ͯ҃-҉ᄀ-ᇿ᪰-᫿᷀-᷿⃐-⃿゙゚︠-︯]")
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def _kept(digits: bool) -> np.ndarray:
    """Which code points count."""
    out = np.zeros(sys.maxunicode + 1, bool)
    out[0xAC00:0xD7A4] = out[0x4E00:0xA000] = out[0x20000:0x2A6E0] = True
    for a, b in ((0, 0xAC00), (0xF900, 0x1FFFF), (0x2A6E0, 0x32000)):
        for c in range(a, b):
            ch = chr(c)
            if ch.isalpha() or digits and ch.isalnum():
                out[c] = True
    return out


def _folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    out = unicodedata.normalize("NFKC", text).casefold()
    if _LOOSE.search(out):  # letters that something invisible may keep apart
        out = unicodedata.normalize("NFKC", "".join(c for c in out if c.isalnum() or unicodedata.category(c)[0] == "M"))
    return out


def letters(texts: list[str | None], digits: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(code points that count, of all texts; offsets, one more than texts). Null counts as empty."""
    folded = [_folded(t) if t else "" for t in texts]
    points = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _kept(digits)[points]
    ends = np.cumsum(np.fromiter(map(len, folded), np.int64, len(folded)))
    before = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
    return points[kept], before[np.concatenate([[0], ends])].astype(np.int64)


def chunks(batch: pa.RecordBatch, text: int = 1) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first row, end row, texts) pieces of a batch of about CHUNK characters."""
    n = batch.num_rows
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
    piece = np.cumsum(size) // (2 * CHUNK)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(piece, piece[at], side="right")))
        yield at, end, batch.column(text).slice(at, end - at).to_pylist()
        at = end


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 2 * CHUNK)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b)])) for b in (BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def prefix_hash(points: np.ndarray) -> np.ndarray:
    """H with H[0] = 0; the hash of points[a:b] is span_hash(H, a, b)."""
    up, _ = _powers(len(points) + 1)
    with np.errstate(over="ignore"):
        x = (points.astype(np.uint64) + np.uint64(0x1F123BB5)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)  # spreads the code points, so that no polynomial of small terms vanishes
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(points)], dtype=np.uint64)])


def span_hash(h: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """Hash of the spans [a, b) by the prefix hash; the same for the same code points wherever they lie."""
    _, down = _powers(len(h))
    with np.errstate(over="ignore"):
        return (h[b] - h[a]) * down[a]


def window_hash(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the window of n at each place (len - n + 1 of them)."""
    if len(points) < n:
        return np.zeros(0, np.uint64)
    h = prefix_hash(points)
    _, down = _powers(len(h))
    with np.errstate(over="ignore"):
        return (h[n:] - h[:-n]) * down[: len(points) - n + 1]


def window_owner(offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of each window of n that lies within one text."""
    count = np.maximum(offs[1:] - offs[:-1] - n + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(owner)) + np.repeat(offs[:-1] - (np.cumsum(count) - count), count)
    return place, owner
