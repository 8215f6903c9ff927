"""Vectorised text kernels for use inside tasks: word and n-gram hashes of many texts at once.

Hashes come in families that are independent of each other: what one family finds, another confirms.
A family may take a key. Under a random one, no text can be made to collide with another on purpose,
so decisions that rest on equal hashes alone take a key of their own in each run.

Every function works on whole texts. Work is cut into slices of about SLICE bytes, so that
temporary arrays stay small whatever the length of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

SLICE = 1 << 20
#: Bytes of a span from which it is hashed by itself.
LONG_SPAN = 256
#: What the hash of a span starts from, by family, and what each step multiplies by.
_SEEDS = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, (4, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The bytes of a lane of eight that belong to a span with 0 to 8 bytes left.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def byte_set(*chars: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Blank characters of the word definition `[^\x20\x09-\x0D]+`.
BLANK = byte_set(0x20, *range(0x09, 0x0E))
#: Everything in ASCII that is neither a letter nor a digit.
PUNCT = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: Lower-cases A-Z only.
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(sizes: Sequence[int], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about `limit` bytes in all; a longer text stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _seeds(family: int, key: bytes) -> np.ndarray:
    """What the hash of a span starts from and what each step multiplies by."""
    if not key:
        return _SEEDS[family]
    return np.frombuffer(hashlib.blake2b(bytes([family]), digest_size=16, key=key).digest(), np.uint64) | np.uint64(1)


def span_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0, key: bytes = b"") -> np.ndarray:
    """A 64-bit hash of the bytes a[start:end] for each span.

    The hash starts from the length and takes in eight bytes at a time, each followed by a
    bijective scrambling; so spans of one length up to eight bytes never collide. Long spans are
    hashed one by one.
    """
    seed, factor = _seeds(family, key)
    n = ends - starts
    h = mix(n.astype(np.uint64) * factor ^ seed)
    lanes = np.ndarray((len(a) + 1,), "<u8", np.append(a, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    left = np.flatnonzero((n > 0) & (n < LONG_SPAN))
    at = 0
    while len(left):
        lane = lanes[starts[left] + at] & _MASK[np.minimum(n[left] - at, 8)]
        h[left] = mix((h[left] ^ lane) * factor)
        at += 8
        left = left[n[left] > at]
    for i in np.flatnonzero(n >= LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(a[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.tobytes()).digest(), "little")
    return h


class Words:
    """The words of a slice of texts: `hash`, `doc` (index of the text), `start`, `end` in `data`."""

    def __init__(self, texts: Sequence[bytes], separators: np.ndarray = BLANK, fold: np.ndarray | None = LOWER, family: int = 0, key: bytes = b""):
        blob = b"\n".join(texts) + b"\n"
        a = np.frombuffer(blob, np.uint8)
        self.data = a = fold[a] if fold is not None else a
        inside = np.zeros(len(a) + 1, np.int8)
        inside[1:] = ~separators[a]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_start = np.concatenate([[0], np.cumsum(lengths)])
        self.doc = np.searchsorted(self.text_start, self.start, "right") - 1
        self.hash = span_hashes(a, self.start, self.end, family, key)
        #: Words of text i are bounds[i]:bounds[i + 1].
        self.bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hashes of all runs of k words; of the whole sequence if it is shorter."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j])
    return out


def small(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches of at most `rows` rows, without a copy; so what a task holds at a time doesn't
    depend on the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encoded(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


def ragged(flat: np.ndarray, offset: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows `which` of a ragged table (flat, offset), joined; and the length of each."""
    n = offset[which + 1] - offset[which]
    ends = np.cumsum(n)
    index = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - offset[which], n)
    return flat[index], n
