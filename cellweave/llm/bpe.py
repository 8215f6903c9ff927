"""BPE encoding and decoding with a pair occurrence index.

All new words of a group of texts are laid out as one linked list of symbols. An index maps each
mergeable pair to all its positions. Ranks that have positions are applied in ascending order,
each to all its positions at once; the neighbours of a merge then enter the lists of the pairs
that they form. A merge only makes pairs of later ranks, so one ascending pass is enough.
Encoded words are remembered in the worker up to a fixed number, after which it starts afresh.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import normalizers

from .characters import OUTSIDE, lower, odd_classes, odd_forms
from .kernels import ragged, small
from .runtime import others, ship, table
from .token_counts import byte_letters

#: Bytes of text that are encoded at a time; a longer text stands alone.
GROUP_BYTES = 1 << 20


def _odd() -> tuple[dict[int, str], list[int]]:
    """What the library treats otherwise than Python: classes, and all code points of texts to be normalized by the library."""
    return odd_classes(), odd_forms()


class WordEncoder:
    """Encodes texts as a lower-casing word BPE file asks for. odd: from _odd(), to spare a task the work."""

    def __init__(self, path: str, odd: tuple[dict[int, str], list[int]] | None = None, room: int = 120_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a, b = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        self.left, self.right, self.n = a, b, max(self.token) + 1
        keys = a * self.n + b
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        letters = byte_letters()
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, byte in letters.items():
            self.inner[byte], self.last[byte] = vocab[c], vocab[c + self.end]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.stand_in, forms = odd or _odd()
        self.odd = np.zeros(OUTSIDE, bool)
        self.odd[forms] = True
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.room = room
        self._forget()

    def _forget(self) -> None:
        self.known = {s: i for i, s in enumerate(self.special)}
        self.flat = np.array([*self.special.values()], np.int64)
        self.offset = np.arange(len(self.special) + 1)
        self.shown = list(self.special)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it doesn't merge."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, joined, and where each word begins."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        a = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[a]
        sym[ends - 1] = self.last[a[ends - 1]]
        n = len(a)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
            rank = self._rank(x, y)
            hit = np.flatnonzero(rank >= 0)
            if not len(hit):
                return
            hit = hit[np.argsort(rank[hit], kind="stable")]
            rank, at = rank[hit], at[hit]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        open_at = np.flatnonzero(after >= 0)
        note(open_at, sym[open_at], sym[open_at + 1])
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            x, y, made = self.left[r], self.right[r], self.made[r]
            to = after[at]
            live = (sym[at] == x) & (to >= 0)
            live[live] = sym[to[live]] == y
            at, to = at[live], to[live]
            if x == y and len(at) > 1:  # in a run of equal symbols every other pair merges, from the left
                opens = np.append(True, to[:-1] != at[1:])
                first = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
                even = (np.arange(len(at)) - first) % 2 == 0
                at, to = at[even], to[even]
            if not len(at):
                continue
            sym[at], sym[to] = made, -1
            right = after[to]
            after[at] = right
            has_right = right >= 0
            before[right[has_right]] = at[has_right]
            left = before[at]
            p, q = left[left >= 0], at[has_right]
            note(np.concatenate([p, q]), np.concatenate([sym[p], sym[q]]), np.concatenate([sym[at[left >= 0]], sym[right[has_right]]]))
        kept = np.flatnonzero(sym >= 0)
        return sym[kept], np.searchsorted(kept, np.append(0, ends))

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            if self.odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
                text = self.normalizer.normalize_str(text)
                shown = text.translate(self.stand_in)  # each character as one of its class, so places stay
                return [text[m.start() : m.end()] for m in self.word.finditer(shown)]
            text = unicodedata.normalize("NFC", text)
        return self.word.findall(lower(text))

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token in it is one word."""
        if not any(s in text for s in self.special):
            return self._words(text)
        return [w for i, part in enumerate(self.at_special.split(text)) for w in ([part] if i % 2 else self._words(part))]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """The ids of each text, and each text decoded: its tokens, joined by a space."""
        if len(self.known) > self.room:
            self._forget()
        known = self.known
        split = [self.split(t) for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in known))
        if new:
            ids, offset = self.merge([w.encode() for w in new])
            tokens = [self.token[i] for i in ids.tolist()]
            at = offset.tolist()
            self.shown += [" ".join(tokens[i:j]) for i, j in zip(at, at[1:])]
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.offset = np.concatenate([self.offset, offset[1:] + len(self.flat)])
            self.flat = np.concatenate([self.flat, ids])
        which = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in split]
        shown = self.shown
        return [ragged(self.flat, self.offset, w)[0] for w in which], [" ".join([shown[i] for i in w.tolist()]) for w in which]

    def decode(self, ids: list[int]) -> str:
        """As a file without a decoder asks for: the tokens, joined by a space."""
        return " ".join([self.token[i] for i in ids])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, odd: tuple[dict[int, str], list[int]] | None = None) -> WordEncoder:
    """The encoder of a file, made once in each process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, odd)
    return _encoders[path]


KINDS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, text: str = "text", outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """Adds the outputs asked for to docs; no shuffle.

    ids, n_tokens: the token ids of the whole text and their number; decoded: the text that they
    decode to; ids_sha256, decoded_sha256: digests of the ids as little-endian unsigned 32-bit
    integers and of the decoded text in UTF-8. Null counts as empty: no tokens. Columns of docs
    with these names, in upper or lower case, are replaced, others stay. Repeated rows are encoded
    each. An empty table gives an empty table.
    """
    ship(docs.sparkSession)
    kept = others(docs, outputs)
    odd = docs.sparkSession.sparkContext.broadcast(_odd())
    schema = docs.select(*kept).schema
    for name in outputs:
        schema = schema.add(name, _type(KINDS[name]))
    arrow = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}

    def made(name: str, ids: np.ndarray, shown: str):
        if name == "ids":
            return ids.astype(np.int32)
        if name == "n_tokens":
            return len(ids)
        if name == "decoded":
            return shown
        return hashlib.sha256(ids.astype("<u4").tobytes() if name == "ids_sha256" else shown.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, odd.value)
        for group in _groups(small(batches), kept.index(text)):
            texts = [x or "" for batch in group for x in batch.column(kept.index(text)).to_pylist()]
            ids, shown = e.encode(texts)
            at = 0
            for batch in group:
                rows = range(at, at := at + batch.num_rows)
                new = [pa.array([made(name, ids[i], shown[i]) for i in rows], arrow.get(name, pa.string())) for name in outputs]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*kept, *outputs])

    return docs.select(*kept).mapInArrow(run, schema)


def _type(ddl: str):
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

    return {"array<int>": ArrayType(IntegerType()), "long": LongType(), "string": StringType()}[ddl]


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[pa.RecordBatch]]:
    """Neighbouring batches with GROUP_BYTES of text together, or a single larger one."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch.column(column).nbytes
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=outputs).select("doc_id", *outputs)
