"""Plain form of a text: the rules, as tables of code points, and a per-string form of them.

A text is in plain form if Hangul and accented letters are composed, Latin letters, digits and ASCII
punctuation aren't replaced by wide, styled or look-alike characters, Hanja are the common characters, the
middle dot is U+00B7, the only white space is the blank and the line break, and nothing is invisible. Signs with
a meaning of their own (squared units, superscripts, degree signs, the ellipsis, circled digits) stay as they are,
and so do words written wholly in Greek or Cyrillic.

The tables are shared with the vectorised kernel of the text subpackage; this module needs no other part.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Characters that are invisible (format characters, fillers, variation selectors).
INVISIBLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
)
# Blanks that aren't the ordinary blank, and breaks that aren't the ordinary line break.
BLANKS = "\t\u000b\u000c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
BREAKS = "\r\u0085\u2028\u2029"
# Dots that stand for the middle dot.
MIDDLE_DOTS = "\u0387\u119e\u2022\u2027\u2219\u22c5\u2e31\u30fb\u318d\uff65"
# Hyphens, dashes and other signs that stand for an ASCII one in any text.
ASCII_SIGNS = {"-": "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63", ".": "\u2024", "/": "\u2044\u2215", ":": "\u2236", "~": "\u223c\u301c", "*": "\u2217", "|": "\u2223"}
# Marks that stand for an ASCII one in a text without Hangul, Hanja or kana.
LATIN_MARKS = {"'": "\u2018\u2019\u201a\u201b\u2032", '"': "\u201c\u201d\u201e\u201f\u2033", ",": "\u3001", "<": "\u2039", ">": "\u203a"}
# Greek and Cyrillic letters that look like a Latin one; they count where their word has a Latin letter.
LOOK_ALIKES = {
    "A": "\u0391\u0410", "B": "\u0392\u0412", "C": "\u03f9\u0421", "E": "\u0395\u0415", "F": "\u03dc", "G": "\u050c", "H": "\u0397\u041d",
    "I": "\u0399\u0406", "J": "\u037f\u0408", "K": "\u039a\u041a", "M": "\u039c\u041c", "N": "\u039d", "O": "\u039f\u041e", "P": "\u03a1\u0420",
    "Q": "\u051a", "S": "\u0405", "T": "\u03a4\u0422", "W": "\u051c", "X": "\u03a7\u0425", "Y": "\u03a5\u0423\u04ae", "Z": "\u0396",
    "a": "\u03b1\u0430", "c": "\u03f2\u0441", "d": "\u0501", "e": "\u0435", "h": "\u04bb", "i": "\u03b9\u0456", "j": "\u03f3\u0458", "k": "\u03ba\u043a",
    "l": "\u04cf", "m": "\u043c", "n": "\u043f", "o": "\u03bf\u043e\u03c3", "p": "\u03c1\u0440", "q": "\u051b", "s": "\u0455", "t": "\u0442",
    "u": "\u03c5", "v": "\u03bd\u0475", "w": "\u051d", "x": "\u03c7\u0445", "y": "\u03b3\u0443\u04af",
}
# Ranges whose compatibility forms are only another dress of common characters: wide and narrow forms, small forms,
# Latin ligatures, styled letters and digits, radicals and compatibility ideographs.
DRESS_RANGES = ((0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0xFE50, 0xFE6B), (0xFF01, 0xFFEF), (0x1D400, 0x1D7FF), (0x2F800, 0x2FA1F))

MIXED_TEXT = ((0x1100, 0x11FF), (0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x3130, 0x318F), (0x3400, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFF66, 0xFFDC), (0x20000, 0x3FFFF))


@lru_cache(maxsize=1)
def replacements() -> dict[int, str]:
    """Code point -> text, for all that doesn't depend on the neighbours ('' takes it out); built by rule."""
    out: dict[int, str] = {}
    for a, b in DRESS_RANGES:
        for c in range(a, b + 1):
            if (n := unicodedata.normalize("NFKC", chr(c))) != chr(c):
                out[c] = n
    for c in [*range(0x20, 0x2FFFF)]:
        ch = chr(c)
        if c >= 0x80 and c not in out and unicodedata.category(ch) == "Nd":
            out[c] = str(unicodedata.digit(ch))
    for c in [*range(0x20), *range(0x7F, 0xA0)]:
        out[c] = ""
    del out[0x0A]
    for text, signs in ((" ", BLANKS), ("\n", BREAKS), ("·", MIDDLE_DOTS)):
        out |= {ord(c): text for c in signs}
    for text, signs in ASCII_SIGNS.items():
        out |= {ord(c): text for c in signs}
    for a, b in INVISIBLE_RANGES:
        out |= dict.fromkeys(range(a, b + 1), "")
    return out


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    def span(ranges) -> str:
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)

    mixed = re.compile(f"[{span(MIXED_TEXT)}]")
    # A word for the look-alikes: a run of letters and marks of Latin, Greek and Cyrillic.
    word = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0300-\u036f\u0370-\u03ff\u0400-\u052f\u1e00-\u1fff]+")
    # Printable ASCII, the line break, composed Hangul, common Hanja and the middle dot need no work.
    plain = re.compile("[\n -~\u00b7\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3]*")
    return mixed, word, plain


_LOOK = {ord(c): text for text, signs in LOOK_ALIKES.items() for c in signs}
_MARKS = {ord(c): text for text, signs in LATIN_MARKS.items() for c in signs}
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff]")


def plain_form(text: str | None) -> str | None:
    """The plain form of one text; null stays null, the empty text stays empty."""
    mixed, word, plain = _patterns()
    if text is None or plain.fullmatch(text):
        return text
    out = text.replace("\r\n", "\n").translate(replacements())
    out = unicodedata.normalize("NFC", out)
    if not mixed.search(out):
        out = out.translate(_MARKS)
    return word.sub(lambda m: m[0].translate(_LOOK) if _LATIN.search(m[0]) else m[0], out)
