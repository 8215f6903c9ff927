"""Benchmark decontamination by greedy string tiling.

A tile is a run of words that a benchmark item and a document share; tiles don't overlap in either
text, and longer ones are laid first. The share of an item's words that tiles of one document
cover tells how much of the item that document gives away, in whatever order its parts stand.

Shared tokens seed the search: every run of `least` words of the benchmark is a seed. Documents are
read once against a bit map of all seeds, whose size is bounded whatever the size of the benchmark,
and keep the places that hit it. A document that gives away enough of an item must hold one of the
item's rarer seeds, so only these are joined; one that nearly all items share brings no pairs.

A pair is tiled from its two sequences, never from the pairs of their equal places: running
Karp-Rabin hashes over both find the greatest length that they still share, all its tiles are laid,
each checked seed by seed, and the search goes on below it. Time and space go with the lengths of
both texts, also where one word or line is repeated throughout.

Words are hashed under a key that is drawn anew in each run, so no text can be written to collide.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import PUNCT, Words, encoded, shingles, slices, small
from .runtime import materialize, ship, table, whole_number

#: Bits of the seeds' map: at least this many for each seed, and at most 2 ** MOST_BITS in all; that is 32 MB
#: as a map and, as words and masks on their way through the driver, at most 67 MB.
BITS_PER_SEED, MOST_BITS = 1024, 28
#: Seeds of items that a document is tiled with at a time, about, and prime and bases of the running hashes.
TOGETHER, PRIME = 400_000, (1 << 31) - 1
#: Documents with candidates in a task, on average.
TASK_PAIRS = 500
_BASES = [int(x) for x in np.random.Generator(np.random.PCG64(31)).integers(1 << 20, PRIME - 1, 2)]


def _words(texts: list[bytes], key: bytes) -> Words:
    return Words([x.decode().lower().encode() if not x.isascii() else x for x in texts], PUNCT, key=key)


def _item_seeds(items: DataFrame, least: int, key: bytes) -> DataFrame:
    """(item, words, width, seeds): the runs of `least` words of each item, in order; the whole item if it is shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = encoded(batch.column(1))
            for i, j in slices([len(x) for x in texts]):
                w = _words(texts[i:j], key)
                own = [w.hash[w.bounds[d] : w.bounds[d + 1]] for d in range(j - i)]
                of = np.array([d for d, h in enumerate(own) if len(h)], np.int64)
                n = np.array([len(own[d]) for d in of], np.int32)
                seeds = [shingles(own[d], least).view(np.int64) for d in of]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + of)), pa.array(n), pa.array(np.minimum(n, least)), pa.array(seeds, pa.list_(pa.int64()))], names=["item", "words", "width", "seeds"])

    return items.mapInArrow(run, "item long, words int, width int, seeds array<long>")


def _doc_seeds(docs: DataFrame, bits: np.ndarray, widths: list[int], key: bytes) -> DataFrame:
    """(doc, body, width, seeds, places) of each document whose runs of `width` words hit the bit map; body: a digest
    of its text, which keeps different texts of one id apart; places: the hits' first words, in order."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        top = np.uint64(len(bits) * 64 - 1)
        for batch in small(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = encoded(batch.column(1))
            for i, j in slices([len(x) for x in texts]):
                w = _words(texts[i:j], key)
                for width in widths:
                    n = len(w.hash) - width + 1
                    if n <= 0:
                        continue
                    s = shingles(w.hash, width)
                    slot = s & top
                    hit = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
                    at = np.flatnonzero((hit > 0) & (w.doc[:n] == w.doc[width - 1 :]))
                    if len(at):
                        own, first = np.unique(w.doc[at], return_index=True)
                        cuts = np.append(first, len(at)).tolist()
                        body = [hashlib.blake2b(texts[i + d], digest_size=16).digest() for d in own]
                        seeds = [s[at[x:y]].view(np.int64) for x, y in zip(cuts, cuts[1:])]
                        places = [(at[x:y] - w.bounds[d]).astype(np.int32) for d, x, y in zip(own, cuts, cuts[1:])]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[i + own], pa.int64()), pa.array(body, pa.binary()), pa.array([width] * len(own), pa.int32()), pa.array(seeds, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["doc", "body", "width", "seeds", "places"])

    return docs.mapInArrow(run, "doc long, body binary, width int, seeds array<long>, places array<int>")


class _Running:
    """Running Karp-Rabin hashes, by two bases, over a sequence of small numbers."""

    def __init__(self, x: np.ndarray, most: int):
        x = x.astype(np.uint64) + np.uint64(1)
        self.sums, self.shift = [], []
        for base in _BASES:
            powers = np.ones(most + 1, np.uint64)
            n, step = 1, base
            while n <= most:
                powers[n : 2 * n] = powers[:n][: most + 1 - n] * np.uint64(step) % np.uint64(PRIME)
                step, n = step * step % PRIME, 2 * n
            terms = x * powers[: len(x)] % np.uint64(PRIME)
            self.sums.append(np.append(np.uint64(0), np.cumsum(terms) % np.uint64(PRIME)))
            self.shift.append(powers[::-1][: len(x)])

    def windows(self, k: int) -> np.ndarray:
        """A hash of each window of k numbers."""
        out = np.zeros(len(self.sums[0]) - k, np.uint64)
        for sums, shift in zip(self.sums, self.shift):
            one = (sums[k:] + np.uint64(PRIME) - sums[:-k]) % np.uint64(PRIME) * shift[: len(out)] % np.uint64(PRIME)
            out = out << np.uint64(31) | one
        return out


def tile(own: np.ndarray, seeds: np.ndarray, places: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (at in the item, place in the document, length) of an item's seeds and a document's seeds at their places.

    Each round takes the longest match of unmarked words that is left (of equal ones the first in
    the item, then in the document) and marks its words in both texts.
    """
    names, own = np.unique(own, return_inverse=True)
    at = np.minimum(np.searchsorted(names, seeds), len(names) - 1)
    known = names[at] == seeds
    seeds, places = at[known], places[known].astype(np.int64)
    if not len(seeds):
        return []
    # words between hits don't matter: gaps count as `width` words at most
    spot = np.append(0, np.cumsum(np.minimum(np.diff(places), width)))
    most = max(len(own), len(seeds))
    a, b = _Running(own, most), _Running(seeds, most)
    marks = [np.zeros(len(own) + width - 1, bool), np.zeros(int(spot[-1]) + width, bool)]

    def free(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of k seeds start whose words are unmarked, in the item and among the document's hits."""
        out = []
        for side, begin in ((0, np.arange(len(own) - k + 1)), (1, spot[: len(seeds) - k + 1])):
            sums = np.append(0, np.cumsum(marks[side]))
            ok = sums[np.minimum(begin + k + width - 1, len(sums) - 1)] == sums[begin]
            if side:
                ok &= places[k - 1 :] - places[: len(seeds) - k + 1] == k - 1
            out.append(np.flatnonzero(ok))
        return out[0], out[1]

    def shared(k: int) -> bool:
        i, j = free(k)
        return bool(len(i) and len(j)) and bool(np.isin(b.windows(k)[j], a.windows(k)[i]).any())

    out, limit = [], min(len(own), len(seeds))
    while limit > 0:
        lo, k = 0, limit  # the greatest k with a shared window; the whole length is tried first
        while lo < limit:
            if shared(k):
                lo = k
            else:
                limit = k - 1
            k = (lo + limit + 1) // 2
        if not lo:
            break
        i, j = free(lo)
        in_a, in_b = a.windows(lo)[i], b.windows(lo)[j]
        order = np.argsort(in_b, kind="stable")
        firsts, lasts = np.searchsorted(in_b[order], in_a), np.searchsorted(in_b[order], in_a, "right")
        passed: dict[int, int] = {}  # of each hash, hits before this one are marked
        n = lo + width - 1
        for x, first, last in zip(i.tolist(), firsts.tolist(), lasts.tolist()):
            if first == last or marks[0][x : x + n].any():
                continue
            y = passed.get(first, first)
            while y < last:
                q = int(j[order[y]])
                where = int(spot[q])
                if marks[1][where : where + n].any():
                    y += 1
                    if passed.get(first, first) == y - 1:
                        passed[first] = y
                elif np.array_equal(own[x : x + lo], seeds[q : q + lo]):
                    marks[0][x : x + n] = marks[1][where : where + n] = True
                    out.append((x, int(places[q]), n))
                    break
                else:
                    y += 1
        limit = lo - 1
    return out


FIGURES = "doc_id long, item long, item_words int, tiles int, longest int, covered int, coverage double"


def _figures(doc: int, seeds: np.ndarray, places: np.ndarray, width: int, items: list, coverage: float) -> Iterator[tuple]:
    """The figures of one document with those of the items of which it holds enough."""
    held = np.unique(seeds)
    for one in items:
        own = np.asarray(one["seeds"], np.int64)
        need = math.ceil(one["words"] * coverage)
        if width * int(np.isin(own, held).sum()) < need:
            continue
        tiles = tile(own, seeds, places, width)
        covered = sum(n for _, _, n in tiles)
        if tiles and covered / one["words"] >= coverage:
            yield doc, one["item"], one["words"], len(tiles), max(n for _, _, n in tiles), covered, covered / one["words"]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 5, coverage: float = 0.5) -> DataFrame:
    """(doc_id, item_id, item_words, tiles, longest, covered, coverage) of each document and item
    of which the document's tiles cover at least `coverage`.

    Words are runs of ASCII letters and digits and of other non-ASCII characters, lowered. A tile
    has `least` words or more; an item with fewer words is one tile. Null, empty and wordless
    texts and items match nothing; null ids are dropped with their rows. Rows that repeat a doc_id
    or an item_id with equal texts count once; different texts under one id are judged each by
    itself, and each pair of them that leaks gives a row.
    """
    spark = docs.sparkSession
    ship(spark)
    whole_number(docs, doc_id)
    whole_number(items, item_id)
    # different texts of one id must not be mixed up: they get numbers of their own
    named = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").distinct()
    named = materialize(named.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    key = os.urandom(16)
    packed = materialize(_item_seeds(named.select("item", "text"), least, key), "benchmark-items-seeds")
    seeds = packed.select("item", "words", "width", F.posexplode("seeds").alias("at", "seed"))
    n_seeds, shapes = packed.agg(F.coalesce(F.sum(F.size("seeds").cast("long")), F.lit(0))).first()[0], sorted(r.width for r in packed.select("width").distinct().collect())
    size = 1 << int(np.clip(np.ceil(np.log2(max(n_seeds, 1) * BITS_PER_SEED)), 12, MOST_BITS))
    # at most size / 64 rows, so this is bounded
    marked = seeds.select((F.col("seed").bitwiseAND(size - 1)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[marked["word"].to_numpy(np.int64)] = marked["mask"].to_numpy(np.int64).view(np.uint64)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    hits = materialize(_doc_seeds(rows, bits, shapes, key), "document-seeds")
    # A tile of n words holds n - width + 1 seeds, n / width at least; so a document that leaks an item holds
    # t = ceil(words * coverage / width) of its seeds, and so one of all but the t - 1 most frequent ones.
    spread = seeds.select("item", "seed").distinct().groupBy("seed").agg(F.count("*").alias("df"))
    t = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("words") * coverage) / F.col("width")))
    placed = seeds.join(spread, "seed").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("df", "seed", "at")))
    rare = placed.where(F.col("rank") <= F.col("words") - F.col("width") + 2 - t).select("seed", "width", "item").distinct()
    pairs = hits.select("doc", "body", "width", F.explode(F.array_distinct("seeds")).alias("seed")).join(materialize(rare, "benchmark-rare"), ["seed", "width"])
    groups = max(1, math.ceil(n_seeds / TOGETHER))
    pairs = pairs.select("doc", "body", "width", "item").distinct().join(packed.drop("width"), "item")
    pairs = pairs.groupBy("doc", "body", "width", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("turn")).agg(F.collect_list(F.struct("item", "words", "seeds")).alias("items"))
    pairs = materialize(pairs.drop("turn"), "leak-candidates", 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 16):
            doc, width, seeds, places, items = (batch.column(c) for c in ("doc", "width", "seeds", "places", "items"))
            out = [f for i in range(batch.num_rows) for f in _figures(doc[i].as_py(), seeds[i].values.to_numpy(), places[i].values.to_numpy(), width[i].as_py(), items[i].as_py(), coverage)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[f.split()[0] for f in FIGURES.split(", ")]).astype({"doc_id": "int64", "item": "int64", "item_words": "int32", "tiles": "int32", "longest": "int32", "covered": "int32", "coverage": "float64"}), preserve_index=False)

    # a document's hits are sent once for each of the groups of items
    met = pairs.join(hits.dropDuplicates(["doc", "body", "width"]), ["doc", "body", "width"]).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs.count() / TASK_PAIRS)))
    out = met.mapInArrow(run, FIGURES).join(named.select("item", "item_id"), "item")
    return out.select("doc_id", "item_id", "item_words", "tiles", "longest", "covered", "coverage")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Each document that holds a benchmark item, with that item: doc_id, item_id and the tiles' figures."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
