"""Quality scores of documents from random-indexing word vectors and a small neural network.

Words: every token has a fixed sparse random index vector; its word vector is the sum of the index
vectors of the tokens around it, over all documents. Tokens are of two kinds: words, and word
shapes (letters of either case, digits and marks, runs drawn together; `=` for a word that
repeats the one before), so that what a text looks like has word vectors too. Tokens share a fixed
number of hashed slots, which bounds the table of vectors whatever the vocabulary. Partial sums
are whole numbers and are added in a tree of groups of FAN, so no task holds more than FAN blocks.

Documents: the vectors of a whole text's tokens, pooled. A two-layer network, fitted in numpy on
at most SAMPLE labelled rows, scores them; a temperature fitted on rows set aside makes its scores
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BLANK, Words, encoded, mix, slices, small, span_hashes
from .runtime import materialize, others, ship, table

WORD_SLOTS, SHAPE_SLOTS, DIM, NONZERO = 8192, 1024, 64, 4
SLOTS = WORD_SLOTS + SHAPE_SLOTS
#: Slots in a block of partial sums, and partial sums that one task adds up.
BLOCK, FAN = 512, 32
#: Labelled rows that the classifier is fitted on at most, by hash order.
SAMPLE = 20_000
FEATURES = 3 * DIM + 1

_rng = np.random.Generator(np.random.PCG64(3))
INDEX_AT = _rng.integers(0, DIM, (SLOTS, NONZERO))
INDEX_SIGN = _rng.choice([-1, 1], (SLOTS, NONZERO))
# The shape of a byte: letters of either case, digits, marks as they are; beyond ASCII a lower-case letter.
_SHAPE = np.array([ord("a") if 97 <= i <= 122 or i >= 128 else ord("A") if 65 <= i <= 90 else ord("0") if 48 <= i <= 57 else i for i in range(256)], np.uint8)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots of the words and of the shapes of a slice of texts, and where each text's words begin."""
    w = Words(texts, BLANK, None)
    words = (w.hash % np.uint64(WORD_SLOTS)).astype(np.int64)
    shape = _SHAPE[w.data]
    keep = np.append(True, shape[1:] != shape[:-1])
    at = np.append(0, np.cumsum(keep))
    h = span_hashes(shape[keep], at[w.start], at[w.end])
    if len(h):
        again = np.append(False, (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))
        h[again] = mix(np.array([61], np.uint64))[0]
    return words, WORD_SLOTS + (h % np.uint64(SHAPE_SLOTS)).astype(np.int64), w.bounds


def _add_contexts(sums: np.ndarray, words: np.ndarray, shapes: np.ndarray, bounds: np.ndarray) -> None:
    """Adds the index vectors of each token's contexts: the shape or word at its place, and both tokens next to it."""
    first = np.zeros(len(words), bool)
    first[bounds[:-1][bounds[:-1] < len(words)]] = True
    inner = np.flatnonzero(~first)  # has a left neighbour in its text
    for of, near in ((words, words), (words, shapes), (shapes, shapes), (shapes, words)):
        sides = [(of[inner], near[inner - 1]), (of[inner - 1], near[inner])]
        if of is not near:
            sides.append((of, near))
        for a, b in sides:
            for k in range(NONZERO):
                sums += np.bincount(a * DIM + INDEX_AT[b, k], INDEX_SIGN[b, k], SLOTS * DIM).astype(np.int64)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(SLOTS * DIM, np.int64)
    for batch in small(batches):
        texts = encoded(batch.column(0))
        for i, j in slices([len(x) for x in texts], 4 << 20):
            _add_contexts(sums, *tokens(texts[i:j]))
    if sums.any():
        blocks = sums.reshape(-1, BLOCK * DIM)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "sums"])


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in pdf["sums"])
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [pdf["group"].iloc[0]], "sums": [total.tobytes()]})


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The word vector of each slot, from all rows of docs, of length 1 (0 for a slot without a token)."""
    ship(docs.sparkSession)
    parts = docs.select(F.col(text).alias("text")).mapInArrow(_partial_sums, "block int, sums binary").select("block", F.spark_partition_id().alias("part"), "sums")
    parts = materialize(parts, "quality-sums")
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        groups = parts.withColumn("group", F.floor(F.col("part") / FAN).cast("int")).groupBy("block", "group")
        parts = materialize(groups.applyInPandas(_added, "block int, part int, sums binary"), "quality-sums")
    out = np.zeros((SLOTS * DIM // (BLOCK * DIM), BLOCK * DIM))
    for row in parts.collect():  # SLOTS / BLOCK rows
        out[row.block] = np.frombuffer(row.sums, np.int64)
    out = out.reshape(SLOTS, DIM)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out = out / np.maximum(size, 1)
    used = size[:, 0] > 0
    if used.any():
        out[used] -= out[used].mean(0)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out.astype(np.float32)


def features(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """For each text: the mean vector of its words, mean and deviation of its shapes, and its log length."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, j in slices([len(x) for x in texts], 1 << 19):
        words, shapes, bounds = tokens(texts[i:j])
        n = np.diff(bounds)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        at, count = bounds[:-1][some], n[some][:, None]
        x = np.add.reduceat(vectors[words], at) / count
        y = vectors[shapes]
        mean = np.add.reduceat(y, at) / count
        spread = np.sqrt(np.maximum(np.add.reduceat(y * y, at) / count - mean * mean, 0))
        out[i + some] = np.hstack([x, mean, spread, np.log1p(count)])
    return out


@dataclass
class Network:
    """Two layers: (x - shift) / scale, tanh, and a logit divided by the temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 128, rate: float = 2e-3, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the log loss; a sixth of the rows, set aside, picks the epoch and the temperature.

    Without rows of both labels the score is the smoothed share of label 1.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    x = x.astype(np.float64)
    dim = x.shape[1]
    if len(np.unique(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(dim), np.ones(dim), np.zeros((dim, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), 1.0)
    order = rng.permutation(len(x))
    aside, own = order[: max(1, len(x) // 6)], order[max(1, len(x) // 6) :]
    shift, scale = x[own].mean(0), x[own].std(0) + 1e-3
    z = (x - shift) / scale
    p = [rng.normal(0, dim**-0.5, (dim, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    best, kept, step = np.inf, p, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * p[0], back.sum(0), h.T @ e + decay * p[2], np.array([e.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        loss = _loss(np.tanh(z[aside] @ p[0] + p[1]) @ p[2] + p[3], y[aside])
        if loss < best:
            best, kept = loss, [a.copy() for a in p]
    out = np.tanh(z[aside] @ kept[0] + kept[1]) @ kept[2] + kept[3]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 71))
    temperature = float(grid[int(np.argmin([_loss(out / t, y[aside]) for t in grid]))])
    return Network(shift, scale, kept[0], kept[1], kept[2], float(kept[3][0]), temperature)


def learn(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Network:
    """Fit on the `sample` labelled documents that come first by a hash of their id."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("y")).orderBy(F.xxhash64(F.col(doc_id).cast("string")), doc_id).limit(sample)
    rows = docs.select(doc_id, F.col(text).alias("text")).join(F.broadcast(chosen), doc_id).select(F.col(doc_id).alias("id"), "text", F.col("y").cast("double"))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            x = features(encoded(batch.column(1)), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast("string"), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    got = rows.mapInArrow(run, "id string, y double, x binary").toPandas().sort_values(["id", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, FEATURES)
    return fit(x, got["y"].to_numpy())


def score(docs: DataFrame, vectors: np.ndarray, net: Network, text: str = "text") -> DataFrame:
    """Adds `score`, the probability of label 1, to docs; no shuffle.

    Null and empty texts have the score of no words at all. A column named score, in upper or lower
    case, is replaced, others stay. Repeated rows are scored each; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    kept = others(docs, ("score",))
    schema = docs.select(*kept).schema.add("score", "double")
    sent = docs.sparkSession.sparkContext.broadcast((vectors, astuple(net)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, parameters = sent.value
        net = Network(*parameters)
        for batch in small(batches):
            x = features(encoded(batch.column(kept.index(text))), vectors)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(net.score(x))], names=[*kept, "score"])

    return docs.select(*kept).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, score, predicted; learned from labels of rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    vectors = word_vectors(docs)
    net = learn(docs, labels, vectors)
    return score(docs, vectors, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
