"""Token counts of whole texts by compiled finite-state transducers.

Two deterministic transducers are compiled from the tokenizer file, once in each worker:

* `Splitter` reads character classes and tells where pre-tokens start. Its transitions generate
  a finite monoid of state maps, which is compiled to a composition table. A slice of texts is
  cut into equal chunks; each chunk's state map is folded from its characters, the maps of all
  chunks are composed by a parallel prefix scan, and with the start states so found the chunks
  are read once more, all at the same time, to emit the starts.
* `PieceCounter` reads the bytes of a pre-token. A state stands for all prefixes that any
  continuation treats alike: the longest suffix that may begin a token, with the last tokens and
  the relative lengths of the encodings that end inside that suffix. Transitions are determinised when first needed and
  carry the change in the number of emitted tokens, which may be negative, so the sum along the
  path is the token count of the pre-token.

Both are exact. Texts are never cut: chunks are joined by their state maps.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .characters import OUTSIDE, mask
from .kernels import slices, small, span_hashes
from .runtime import others, ship

# Classes of characters. R, E, V, L and S end the contractions 're 've 'll 's 't 'm 'd.
_LETTER, _S, _R, _E, _V, _L, _NUMBER, _OTHER, _QUOTE, _SPACE, _WHITE, _RESET = range(12)
# States: what the pre-token in progress is.
_START, _LETTERS, _NUMBERS, _OTHERS, _ONE_SPACE, _SPACES, _ONE_WHITE, _WHITES, _Q, _Q_R, _Q_V, _Q_L, _DONE = range(13)
_STATES = 13
#: Bytes of a pre-token up to which its count is remembered.
LONG_PIECE = 256
# Emissions: a pre-token starts at this character, at the one before it.
_HERE, _BEFORE = 1, 2


def _step(state: int, c: int) -> tuple[int, int]:
    """The next state and what is emitted, by the rule
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"""
    if c == _RESET:
        return _START, _HERE | (_BEFORE if state in (_Q_R, _Q_V, _Q_L) else 0)
    letter = c <= _L
    kind = _LETTERS if letter else _NUMBERS if c == _NUMBER else _OTHERS
    if c in (_SPACE, _WHITE):
        if state in (_ONE_SPACE, _SPACES, _ONE_WHITE, _WHITES):
            return (_SPACES if c == _SPACE else _WHITES), 0
        return (_ONE_SPACE if c == _SPACE else _ONE_WHITE), _HERE | (_BEFORE if state in (_Q_R, _Q_V, _Q_L) else 0)
    if state == _ONE_SPACE:
        return kind, 0
    if state == _SPACES:
        return kind, _BEFORE
    if state == kind or (state == _Q and kind == _OTHERS):
        return kind, 0
    if state == _Q and c in (_S, _R, _V, _L):
        return {_S: _DONE, _R: _Q_R, _V: _Q_V, _L: _Q_L}[c], 0
    if (state, c) in ((_Q_R, _E), (_Q_V, _E), (_Q_L, _L)):
        return _DONE, 0
    if state in (_Q_R, _Q_V, _Q_L) and letter:
        return _LETTERS, _BEFORE
    before = _BEFORE if state in (_WHITES, _Q_R, _Q_V, _Q_L) else 0
    return (_Q if c == _QUOTE else kind), _HERE | before


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point, as the library has it."""
    out = np.full(OUTSIDE + 1, _OTHER, np.uint8)
    for name, c in (("letter", _LETTER), ("number", _NUMBER), ("space", _WHITE)):
        out[mask(name)] = c
    for c, of in ((_S, "stmd"), (_R, "r"), (_E, "e"), (_V, "v"), (_L, "l"), (_QUOTE, "'"), (_SPACE, " ")):
        out[[ord(x) for x in of]] = c
    out[OUTSIDE] = _RESET
    return out


class Splitter:
    """Where pre-tokens start, by the transition monoid and a prefix scan over chunks."""

    def __init__(self, chunk: int = 256):
        self.chunk = chunk
        steps = [[_step(s, c) for s in range(_STATES)] for c in range(12)]
        letters = [tuple(x for x, _ in row) for row in steps]
        identity = tuple(range(_STATES))
        maps, index, at = [identity], {identity: 0}, 0
        while at < len(maps):  # closes the set of state maps under reading one more character
            for g in letters:
                m = tuple(g[s] for s in maps[at])
                if m not in index:
                    index[m] = len(maps)
                    maps.append(m)
            at += 1
        self.maps = np.array(maps, np.int64)
        n = len(maps)
        #: read[m * 12 + c]: the map of m followed by a character of class c.
        self.read = np.array([[index[tuple(g[s] for s in m)] for g in letters] for m in maps], np.int64).ravel()
        #: compose[a * n + b]: a, then b.
        self.compose = np.array([[index[tuple(b[s] for s in a)] for b in maps] for a in maps], np.int64).ravel()
        self.next = np.array(letters, np.int64).T.ravel()
        self.emit = np.array([[e for _, e in row] for row in steps], np.uint8).T.ravel()
        self.size = n

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """True where a pre-token starts; the stream begins in the start state."""
        n, width = len(classes), self.chunk
        lanes = -(-n // width)
        padded = np.full(lanes * width, _RESET, np.uint8)
        padded[:n] = classes
        by_step = np.ascontiguousarray(padded.reshape(lanes, width).T).astype(np.int64)
        m = np.zeros(lanes, np.int64)
        for c in by_step:
            m = self.read[m * 12 + c]
        gap = 1
        while gap < lanes:  # prefix scan: m[i] becomes the map of chunks 0 to i
            m[gap:] = self.compose[m[:-gap] * self.size + m[gap:]]
            gap *= 2
        state = np.full(lanes, _START, np.int64)
        state[1:] = self.maps[m[:-1], _START]
        said = np.empty((width, lanes), np.uint8)
        for j, c in enumerate(by_step):
            at = state * 12 + c
            said[j] = self.emit[at]
            state = self.next[at]
        said = said.T.reshape(-1)[:n]
        out = (said & _HERE) > 0
        out[:-1] |= (said[1:] & _BEFORE) > 0
        return out


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the others follow from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceCounter:
    """The number of tokens of a pre-token, by a transducer that is determinised on demand."""

    def __init__(self, merges: list[tuple[bytes, bytes]], room: int = 250_000):
        self.rank = {m: i for i, m in enumerate(merges)}
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for i, (a, b) in enumerate(merges):
            self.made.setdefault(a + b, (i, a, b))
        self.tokens = {bytes([b]) for b in range(256)} | {t for t in self.made if self._whole(t)}
        self.beginnings = {t[:n] for t in self.tokens for n in range(len(t))}
        self.room = room
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.move: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.start = self._state((b"", (b"",), (0,)))

    def _state(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
        return self.ids[key]

    def _whole(self, t: bytes) -> bool:
        """Whether the bytes of a merged token are encoded as that one token."""
        _, a, b = self.made[t]
        return self._meet(a, b, self.rank[a, b])

    def _meet(self, a: bytes, b: bytes, before: float = float("inf")) -> bool:
        """Whether tokens a and b, side by side, stay apart until merges of rank `before`.

        Only pieces at the seam can merge across it: at the time of a merge of rank x they are
        the largest ones of a's right edge and b's left edge that are made earlier. Among
        equal ranks the left-most merge comes first.
        """
        left, last = [], before
        while True:
            made = self.made.get(a)
            left.append((a, -1 if made is None else made[0], last))
            if made is None:
                break
            last, a = made[0], made[2]
        last = before
        while True:
            made = self.made.get(b)
            since = -1 if made is None else made[0]
            for x, x_since, x_last in left:
                r = self.rank.get((x, b))
                if r is not None and x_since <= r < x_last and since < r <= last and r < before:
                    return False
            if made is None:
                return True
            last, b = made[0], made[1]

    def _apart(self, a: bytes, b: bytes) -> bool:
        if (a, b) not in self.pairs:
            self.pairs[a, b] = self._meet(a, b)
        return self.pairs[a, b]

    def _go(self, state: int, byte: int) -> tuple[int, int]:
        """state: a suffix of the prefix read so far; at each of its positions where a
        token may have begun, the last token of the encoding that ends there (empty at a pre-token's start) and how many tokens that
        encoding has more than the whole prefix's.

        An encoding without its last token is the encoding of a shorter prefix, so the last token
        is the one suffix that stands apart from the last token before it.
        """
        suffix, lasts, more = self.states[state]
        grown = suffix + bytes([byte])
        for i in range(len(grown)):
            last = grown[i:]
            if last in self.tokens and lasts[i] is not None and (not lasts[i] or self._apart(lasts[i], last)):
                break
        else:
            raise ValueError("the merges are not those of a byte-level BPE")
        delta = more[i] + 1
        cut = 0
        while grown[cut:] not in self.beginnings:
            cut += 1
        lasts, more = (*lasts, last), (*more, delta)
        open_at = [i for i in range(cut, len(lasts)) if grown[i:] in self.beginnings]
        lasts = tuple(lasts[i] if i in open_at else None for i in range(cut, len(lasts)))
        more = tuple(more[i] - delta if i in open_at else 0 for i in range(cut, len(more)))
        self.move[state << 8 | byte] = out = self._state((grown[cut:], lasts, more)), delta
        return out

    def count(self, piece: bytes) -> int:
        state, n = self.start, 0
        move = self.move
        for b in piece:
            to = move.get(state << 8 | b)
            if to is None:
                to = self._go(state, b)
            state = to[0]
            n += to[1]
        if len(self.states) > self.room:
            self._forget()
        return n


class TokenCounter:
    """Token counts of texts for a byte-level tokenizer file."""

    def __init__(self, path: str, room: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda x: bytes(letters[c] for c in x)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.pieces = PieceCounter([(raw(a), raw(b)) for a, b in merges])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.splitter, self.classes = Splitter(), _classes()
        self.known: dict[bytes, int] = {}
        self.room = room
        self.key = os.urandom(16)  # equal pieces of a slice are found by hash, which no text can foresee

    def _stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts, each followed by a separator, and the length of each part.
        A special token is one character that always stands alone."""
        found = [len(x) + 1 for x in texts]
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32).copy()
        lengths = np.array(found, np.int64)
        points[np.cumsum(lengths) - 1] = OUTSIDE
        return points, lengths

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        parts, of = [], []
        for i, text in enumerate(texts):
            split = [text]
            if any(s in text for s in self.special):
                split = regex.split("|".join(map(regex.escape, self.special)), text)
                extra[i] = len(split) - 1
            parts += split
            of += [i] * len(split)
        points, lengths = self._stream(parts)
        starts = self.splitter.starts(self.classes[points])
        ends_of_parts = points == OUTSIDE
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + ((points >= 0x10000) & ~ends_of_parts)
        width[ends_of_parts] = 1
        at = np.concatenate([[0], np.cumsum(width)])
        data = "\0".join([*parts, ""]).encode()
        a = np.frombuffer(data, np.uint8)
        first = np.flatnonzero(starts)
        last = np.append(first[1:], len(points))
        real = ~ends_of_parts[first]
        begin, end = at[first[real]], at[last[real]]
        part = np.searchsorted(np.cumsum(lengths), first[real], "right")
        _, index, inverse = np.unique(span_hashes(a, begin, end, key=self.key), return_index=True, return_inverse=True)
        known, count = self.known, self.pieces.count
        if len(known) > self.room:
            known.clear()
        each = np.empty(len(index), np.int64)
        for i, (b, e) in enumerate(zip(begin[index].tolist(), end[index].tolist(), strict=True)):
            piece = data[b:e]
            n = known.get(piece)
            if n is None:
                n = count(piece)
                if e - b <= LONG_PIECE:
                    known[piece] = n
            each[i] = n
        return extra + np.bincount(np.asarray(of)[part], each[inverse], len(texts)).astype(np.int64)


@lru_cache(4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit (n_tokens > limit) to docs; no shuffle.

    path: a byte-level BPE file, found under the same path on every executor. Null and empty
    texts have no bytes and no tokens. Columns of docs with these names, in upper or lower case, are
    replaced, all others stay. Repeated rows are counted each. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    names = ("n_bytes", "n_tokens", "over_limit")
    kept = others(docs, names)
    schema = docs.select(*kept).schema
    for name, kind in zip(names, ("long", "long", "boolean"), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in small(batches):
            texts = ["" if x is None else x for x in batch.column(kept.index(text)).to_pylist()]
            sizes = np.array([len(x.encode()) for x in texts], np.int64)
            tokens = np.concatenate([np.zeros(0, np.int64), *(c.counts(texts[i:j]) for i, j in slices(sizes))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=[*kept, *names])

    return docs.select(*kept).mapInArrow(run, schema)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_bytes, n_tokens, over_limit."""
    import public_tokenizers

    from .runtime import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(docs, path).select("doc_id", F.col("n_bytes"), F.col("n_tokens"), F.col("over_limit"))
