"""Character classes and normal forms as the tokenizers library has them.

Its Unicode tables are neither Python's nor those of the `regex` package, so classes are taken from
the library's own regular expressions, once in each process, and sent to tasks as ranges.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Regex, normalizers, pre_tokenizers

OUTSIDE = 0x110000
#: Planes that hold characters other than private ones; the rest is in no class.
_PLANES = (range(0x40000), range(0xE0000, 0xE1000))
#: Code points that the library is asked about at a time, which bounds the memory that it takes.
PART = 4096
PATTERNS = {"letter": r"\p{L}+", "number": r"\p{N}+", "space": r"\s+"}


@lru_cache(1)
def points() -> np.ndarray:
    return np.array([i for r in _PLANES for i in r if not 0xD800 <= i < 0xE000])


@lru_cache
def ranges(name: str) -> list[tuple[int, int]]:
    """The ranges (first, last) of code points that belong to a class of PATTERNS."""
    own = points()
    inside = np.ones(len(own) + 2, bool)
    split = pre_tokenizers.Split(Regex(PATTERNS[name]), "removed")
    for at in range(0, len(own), PART):
        for _, (a, b) in split.pre_tokenize_str("".join(map(chr, own[at : at + PART]))):
            inside[at + a + 1 : at + b + 1] = False
    inside[[0, -1]] = False
    edge = np.diff(inside.astype(np.int8))
    out = []
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        cuts = np.flatnonzero(np.diff(own[a:b]) > 1)  # a gap between planes ends a range
        out += [(int(own[x]), int(own[y])) for x, y in zip(np.append(a, a + cuts + 1), np.append(a + cuts, b - 1))]
    return out


@lru_cache
def mask(name: str) -> np.ndarray:
    """Whether each code point, and OUTSIDE, belongs to a class."""
    out = np.zeros(OUTSIDE + 1, bool)
    for a, b in ranges(name):
        out[a : b + 1] = True
    return out


@lru_cache(1)
def odd_classes() -> dict[int, str]:
    """Code points of another class in the `regex` package, with a character that both put in the library's class."""
    own = points()
    text = "".join(map(chr, own))
    here, there = np.zeros(len(own), np.int8), np.zeros(len(own), np.int8)
    for k, (name, pattern) in enumerate(PATTERNS.items(), 1):
        there[mask(name)[own]] = k
        for m in regex.finditer(pattern, text):
            here[m.start() : m.end()] = k
    return {int(p): "!a1 "[k] for p, k in zip(own[here != there], there[here != there])}


def _each(normalizer, texts: list[str]) -> list[str]:
    """Each text by itself through a normalizer of the library, in one call. No text holds a line feed."""
    return normalizer.normalize_str("\n".join(texts)).split("\n")


def lower(text: str) -> str:
    """Python's lower case of each character by itself."""
    return text.replace("Σ", "σ").lower()


@lru_cache(1)
def odd_forms() -> list[int]:
    """Code points that the library composes, orders or lowers in another way than Python does, or
    whose lower form is in odd_classes."""
    odd: set[str] = set()
    own = points()[points() >= 128]
    for at in range(0, len(own), PART):
        chars = [chr(p) for p in own[at : at + PART]]
        odd.update(c for c, x in zip(chars, _each(normalizers.Lowercase(), chars), strict=True) if lower(c) != x or any(ord(y) in odd_classes() for y in x))
        pairs = [unicodedata.normalize("NFD", c) for c in chars if unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<")]
        # each character alone, and beside a mark of the least and of the greatest class, so that its own class shows
        for ask, of in ((chars, chars), ([f"a{c}\u0334" for c in chars], chars), ([f"a\u0345{c}" for c in chars], chars), (pairs, pairs)):
            for t, c, x in zip(ask, of, _each(normalizers.NFC(), ask) if ask else [], strict=True):
                if unicodedata.normalize("NFC", t) != x:
                    odd.update(c)
    return sorted(map(ord, odd))
