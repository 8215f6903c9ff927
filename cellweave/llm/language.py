"""Language identification with language-bitmask n-gram filters.

Learning counts the character n-grams of each language over all rows given, as a Spark
aggregation. An n-gram belongs to a language if it makes up at least `min_share` of that
language's n-grams and at least 1/`contrast` of its share in the language that uses it most; so
the languages of an n-gram stay the same however much text, and strays in it, there is. At most
1/min_share n-grams of a length belong to a language: that bounds what reaches the driver.

The filter is one bit-sliced Bloom filter for all languages: each slot holds a bit mask with one
bit per language. The masks of an n-gram's slots, and-ed, give all languages that contain it, with
one look-up for all of them. A text's popcount per language, less the false positives to be
expected from that language's load, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .characters import OUTSIDE, mask
from .kernels import mix, slices, small
from .runtime import materialize, others, ship, table

_SPACE = 0x20
#: Lengths of the n-grams. Three code points of 21 bits fit a long.
LENGTHS = (2, 3)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of the texts as longs, the text of each, and the number of letters of each text.

    Letters are lowered; a run of anything else is one space, which marks a word's edge and never
    stands inside an n-gram.
    """
    points = np.frombuffer("\0".join([*(x.lower() for x in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter((len(x.lower()) + 1 for x in texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    points[ends - 1] = OUTSIDE
    letter = mask("letter")[points]
    doc = np.repeat(np.arange(len(texts)), lengths)
    n_letters = np.bincount(doc[letter], minlength=len(texts))
    edge = ~letter
    keep = letter.copy()
    keep[1:] |= edge[1:] & letter[:-1]  # the first of a run of others ends a word,
    keep[:-1] |= edge[:-1] & letter[1:]  # the last of it begins one
    p, doc, letter = np.where(letter, points, _SPACE)[keep], doc[keep], letter[keep]
    out, of = [], []
    for n in LENGTHS:
        m = len(p) - n + 1
        if m <= 0:
            continue
        ok = doc[:m] == doc[n - 1 :]
        for j in range(1, n - 1):
            ok &= letter[j : m + j]
        if n == 2:
            ok &= letter[:m] | letter[1:]
        else:
            ok &= letter[1 : m + 1]
        g = np.zeros(m, np.int64)
        for j in range(n):
            g = g << 21 | p[j : m + j]
        out.append(g[ok])
        of.append(doc[:m][ok])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_letters
    return np.concatenate(out), np.concatenate(of), n_letters


@dataclass
class LanguageFilter:
    """languages in order; masks [slots, words of 64 languages]; rate: false positives by language."""

    languages: list[str]
    masks: np.ndarray
    hashes: int
    rate: np.ndarray

    def languages_of(self, g: np.ndarray) -> np.ndarray:
        """The bit mask of languages of each n-gram."""
        h = mix(g.astype(np.uint64))
        step = mix(h) | np.uint64(1)
        top = np.uint64(len(self.masks) - 1)
        out = self.masks[(h & top).astype(np.int64)]
        for j in range(1, self.hashes):
            out = out & self.masks[((h + np.uint64(j) * step) & top).astype(np.int64)]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and how clearly it leads, from 0 to 1."""
        g, doc, n_letters = grams([x or "" for x in texts])
        found = self.languages_of(g)
        n = np.bincount(doc, minlength=len(texts)).astype(float)
        hits = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            bit = (found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            hits[:, k] = np.bincount(doc[bit > 0], minlength=len(texts))
        hits = np.maximum(hits - n[:, None] * self.rate, 0) / (1 - self.rate)
        best = hits.argmax(1)  # of equal ones the first in order
        top = hits.max(1)
        weight = np.exp(8 * (hits - top[:, None]) / np.maximum(n, 1)[:, None])
        score = np.where(top > 0, 1 / weight.sum(1), 0.0)
        known = n_letters > 0
        return [self.languages[b] if ok else "und" for b, ok in zip(best, known, strict=True)], np.where(known, score, 0.0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a partition's (lang, text) rows, each pair once or a few times."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size: dict[str, int] = {}

    def packed(lang: str) -> tuple[np.ndarray, np.ndarray]:
        g = np.concatenate([a for a, _ in held[lang]])
        n = np.concatenate([b for _, b in held[lang]])
        g, inverse = np.unique(g, return_inverse=True)
        return g, np.bincount(inverse, n, len(g)).astype(np.int64)

    for batch in small(batches):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, j in slices([len(x) for x in texts]):
            g, doc, _ = grams(texts[i:j])
            names, of = np.unique(np.array(langs[i:j], object).astype(str), return_inverse=True)
            for k, lang in enumerate(names.tolist()):
                a, n = np.unique(g[of[doc] == k], return_counts=True)
                held.setdefault(lang, []).append((a, n))
                size[lang] = size.get(lang, 0) + len(a)
                if size[lang] > 500_000 and len(held[lang]) > 1:
                    held[lang] = [packed(lang)]
                    size[lang] = 0
    for lang in held:
        g, n = packed(lang)
        for at in range(0, len(g), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g[part]), pa.string()), pa.array(g[part]), pa.array(n[part])], names=["lang", "gram", "n"])


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", min_share: float = 2e-5, contrast: float = 8, slots: int = 1 << 20, hashes: int = 3) -> LanguageFilter:
    """Learn from all rows of docs whose lang and text are not null."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "language-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(totals, "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= min_share)
    found = (
        share.groupBy("gram")
        .agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("by"))
        .select("gram", F.expr(f"transform(filter(by, x -> x.share * {contrast} >= most), x -> x.lang)").alias("langs"))
        .toPandas()
    )
    languages = sorted({x for langs in found["langs"] for x in langs})
    index = {x: i for i, x in enumerate(languages)}
    masks = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
    filt = LanguageFilter(languages, masks, hashes, np.zeros(len(languages)))
    h = mix(found["gram"].to_numpy(np.int64).astype(np.uint64)) if len(found) else np.zeros(0, np.uint64)
    step = mix(h) | np.uint64(1)
    own = np.zeros((len(found), masks.shape[1]), np.uint64)
    for i, langs in enumerate(found["langs"]):
        for x in langs:
            own[i, index[x] // 64] |= np.uint64(1 << index[x] % 64)
    for j in range(hashes):
        np.bitwise_or.at(masks, ((h + np.uint64(j) * step) & np.uint64(slots - 1)).astype(np.int64), own)
    for k in range(len(languages)):
        load = ((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()
        filt.rate[k] = load**hashes
    return filt


def identify(docs: DataFrame, filt: LanguageFilter, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to docs; no shuffle.

    lang_pred is `und`, with score 0, if the text is null or has no letter, and if no language was
    learned. Of languages with equal counts the first in order wins. Columns with these names, in
    upper or lower case, are replaced, others (a `lang` too) stay and are not looked at. Repeated
    rows are judged each; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = others(docs, ("lang_pred", "score"))
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    sent = spark.sparkContext.broadcast((filt.languages, filt.masks, filt.hashes, filt.rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = LanguageFilter(*sent.value)
        for batch in small(batches):
            texts = batch.column(kept.index(text)).to_pylist()
            langs: list[str] = []
            scores = [np.zeros(0)]
            if f.languages:
                for i, j in slices([len(x or "") for x in texts]):
                    a, b = f.predict(texts[i:j])
                    langs += a
                    scores.append(b)
            else:
                langs, scores = ["und"] * len(texts), [np.zeros(len(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, lang_pred, score; learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents")
    filt = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), filt).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
