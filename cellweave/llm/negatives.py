"""Hard negatives by lists that anchors share: exact search by integer inner product.

Anchors are clustered by direction. For a cluster, candidates are sorted once by an upper bound of
their product with any of its members: a candidate of norm v at angle c from the centre, and members
up to an angle b from it, give no more than v cos(c - b) for each unit of a member's norm. Every
member walks that list and stops for certain once the bound falls below the worst score it would
still take.

In Spark a cluster's list is spread over blocks of candidates. The head of the list, the candidates
with the largest products with the centre, is walked first and gives each member a floor. A block of
anchors then meets only blocks of candidates whose bound reaches its floors; in such a pair the block's
part of the list is sorted once and walked by all members. Positives are found first, then, between
two bounds that follow from each positive's score, its negatives.

Vectors are whole numbers, so scores are exact: they are computed in single precision where no
product can exceed 2^24, in double precision up to 2^53, and in integers beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import join_hot, materialize, sample, ship, table, whole_number

#: Numbers of a block of candidates, anchors of a block, anchor blocks that meet a block of candidates at a time.
BLOCK_NUMBERS, ANCHORS, TOGETHER = 1 << 21, 1024, 16
#: Anchors (and numbers of them) that the centres are fitted on, centres of a length of vectors, lengths that get centres.
SAMPLE, SAMPLE_NUMBERS, CENTRES, LENGTHS = 4096, 1 << 21, 64, 16
#: Candidates of a list's head, of a step of the walk, and the least that a block gives to a head.
HEAD, STEP, LEAST_HEAD = 2048, 512, 8
#: Vectors as long as this have products that don't fit a long, so they take no part.
LONGEST = 2.0**31
#: Slack of the bounds for a norm of 1, above the rounding of arc cosines in double precision.
SLACK = 1e-6
_NONE, _ALL = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def centres(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit vectors in the middle of the directions of x, by k-means on the sphere."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = unit[np.random.Generator(np.random.PCG64(5)).permutation(len(unit))[:k]]
    for _ in range(rounds):
        own = (unit @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, unit)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(n > 1e-9, sums / np.maximum(n, 1e-9), out)
    return out


def _angles(x: np.ndarray, norms: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centre / np.maximum(norms, 1e-300), -1, 1))


def bounds(x: np.ndarray, norms: np.ndarray, centre: np.ndarray | None, spread: float) -> np.ndarray:
    """What the product of each x with a unit vector within the angle `spread` of the centre can't exceed."""
    if centre is None:
        return norms * (1 + SLACK)
    return norms * (np.cos(np.maximum(0, _angles(x, norms, centre) - spread)) + SLACK)


class Block:
    """A packed block of vectors: ids, labels, whole numbers, norms."""

    def __init__(self, row):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.whole = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.ids), -1)
        self.x = self.whole.astype(np.float64)
        self.norms = np.sqrt((self.x * self.x).sum(1))


def _products(a: Block, rows: np.ndarray, b: Block, columns: np.ndarray) -> np.ndarray:
    most = a.norms[rows].max(initial=0) * b.norms[columns].max(initial=0)
    if most >= 2.0**52:
        return a.whole[rows].astype(np.int64) @ b.whole[columns].astype(np.int64).T
    kind = np.float32 if most < 2**23 else np.float64
    return (a.x[rows].astype(kind) @ b.x[columns].astype(kind).T).astype(np.int64)


def walk(anchors: Block, cands: Block, at: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, centre: np.ndarray | None, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best candidates of each slot, and how many products that took.

    A slot is a search of the anchor at[slot] for scores from low[slot] to high[slot], among its own
    label if `same`, else among the others. Returns slots, ids and scores of what was found, the
    score that each slot would still take, and the number of products.
    """
    bound = bounds(cands.x, cands.norms, centre, spread)
    order = np.argsort(-bound, kind="stable")
    need, norms, work = low.copy(), anchors.norms[at], 0
    slots, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
    for s in range(0, len(order), STEP):
        top = bound[order[s]]
        waiting = np.flatnonzero((norms * top + SLACK >= need) & (low <= high))
        if not len(waiting):
            break
        here = order[s : s + STEP]
        rows, own = np.unique(at[waiting], return_inverse=True)
        sims = _products(anchors, rows, cands, here)
        work += sims.size
        alike = (anchors.labels[rows][:, None] == cands.labels[here]) == same
        alike &= anchors.ids[rows][:, None] != cands.ids[here]
        sims = sims[own]
        i, j = np.nonzero((sims >= need[waiting, None]) & (sims <= high[waiting, None]) & alike[own])
        if len(i):
            slots, ids, scores = np.append(slots, waiting[i]), np.append(ids, cands.ids[here[j]]), np.append(scores, sims[i, j])
            best = np.lexsort((ids, -scores, slots))
            slots, ids, scores = slots[best], ids[best], scores[best]
            place = np.arange(len(slots)) - np.searchsorted(slots, slots)
            full = place == k - 1
            need[slots[full]] = np.maximum(need[slots[full]], scores[full])
            slots, ids, scores = slots[place < k], ids[place < k], scores[place < k]
    return slots, ids, scores, need, work


def _share(score: np.ndarray, percent: int) -> np.ndarray:
    """floor(percent * score / 100), without leaving 64 bits."""
    return percent * (score // 100) + percent * (score % 100) // 100


_BLOCK = "dim int, cell int, ids binary, labels binary, vectors binary, kind string"


def _packed(name: str, extra: dict | None = None):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        kind, dim = "<i8" if pdf["wide"].any() else "<i2", int(first["dim"])
        vectors = [np.frombuffer(v, "<i8" if w else "<i2").astype(kind) for v, w in zip(pdf["vector"], pdf["wide"])]
        row = {name: f"{dim}:{first['cell']}:{first['part']}", "dim": dim, "cell": first["cell"], "ids": pdf["id"].to_numpy(np.int64).tobytes(), "labels": pdf["label"].to_numpy(np.int64).tobytes(), "vectors": np.concatenate(vectors).tobytes(), "kind": kind}
        if extra is not None:
            block, middle = Block(row), extra.get(dim)
            row["spread"] = math.pi if middle is None else float(_angles(block.x, block.norms, middle[row["cell"]])[block.norms > 0].max(initial=0.0))
        return pd.DataFrame([row])

    return pack


def _blocks(rows: DataFrame, per: Column, name: str, middles: dict | None = None) -> DataFrame:
    """rows packed by cell in parts of about `per` rows, a table with one row for each part."""
    sizes = rows.groupBy("dim", "cell").agg(F.count("*").alias("n")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") / per)))
    dealt = join_hot(rows, materialize(sizes, f"{name}-sizes"), ["dim", "cell"], "n").withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    schema = f"{name} string, {_BLOCK}" + ("" if middles is None else ", spread double")
    return materialize(dealt.groupBy("dim", "cell", "part").applyInPandas(_packed(name, middles), schema), name, 4)


def _quantised(rows: DataFrame, scale: float, middles: dict) -> DataFrame:
    """rows (id, label, anchor, vector) with whole numbers in two or eight bytes each, and their cell: the nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            n = column.value_lengths().to_numpy()
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(n) - n
            for dim in np.unique(n):
                own = np.flatnonzero(n == dim)
                with np.errstate(over="ignore"):
                    x = np.floor(scale * values[starts[own][:, None] + np.arange(dim)])
                    fits = np.sqrt((x * x).sum(1)) < LONGEST
                own, x = own[fits], x[fits]
                wide = (np.abs(x) >= 2**15).any(1)
                middle = middles.get(int(dim))
                cell = np.zeros(len(x), np.int32) if middle is None else (x @ middle.T).argmax(1).astype(np.int32)
                vectors = [v.astype("<i8" if w else "<i2").tobytes() for v, w in zip(x, wide)]
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), dim, np.int32)), pa.array(cell), *(batch.column(c).take(at) for c in ("id", "label", "anchor")), pa.array(wide), pa.array(vectors, pa.binary())],
                    names=["dim", "cell", "id", "label", "anchor", "wide", "vector"],
                )

    return rows.mapInArrow(run, "dim int, cell int, id long, label long, anchor boolean, wide boolean, vector binary")


def _fit(rows: DataFrame, scale: float) -> dict[int, np.ndarray]:
    """Centres for each length of vectors, fitted on at most SAMPLE anchors, the first ones by a hash."""
    lengths = rows.where("anchor").groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    out = {}
    for dim, n in lengths:
        most = max(64, min(SAMPLE, SAMPLE_NUMBERS // dim))
        chosen = sample(rows.where(F.col("anchor") & (F.size("vector") == dim)), most, "id", "vector").select("vector").collect()
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(scale * np.array(sorted(r.vector for r in chosen), float))
            x = x[np.isfinite(x).all(1) & (np.abs(x).max(1) < LONGEST)]
        if len(x):
            out[dim] = centres(x, max(1, min(CENTRES, len(x) // 8)))
    return out


def _lists(blocks: DataFrame, spreads: dict, middles: dict) -> tuple[DataFrame, DataFrame]:
    """(heads, reach): the head of each cluster's list, packed, and each block's greatest bound in each list, from one pass."""
    n = blocks.count()
    most = max(LEAST_HEAD, math.ceil(HEAD / max(n, 1)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, row in pdf.iterrows():
                block, dim = Block(row), int(row["dim"])
                for cell in range(len(middles[dim]) if dim in middles else 1):
                    if (dim, cell) not in spreads:
                        continue
                    centre = None if dim not in middles else middles[dim][cell]
                    near = block.norms if centre is None else block.x @ centre
                    best = np.argpartition(-near, most - 1)[:most] if len(near) > most else np.arange(len(near))
                    top = bounds(block.x, block.norms, centre, spreads[dim, cell]).max()
                    yield pd.DataFrame([{"dim": dim, "cell": cell, "block": row["block"], "top": top, "ids": block.ids[best].tobytes(), "labels": block.labels[best].tobytes(), "vectors": block.whole[best].tobytes(), "kind": row["kind"]}])

    found = materialize(blocks.mapInPandas(run, f"{_BLOCK}, block string, top double"), "list-heads", 4)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [Block(r) for _, r in pdf.iterrows()]
        kind = "<i8" if (pdf["kind"] == "<i8").any() else "<i2"
        row = pdf.iloc[:1][["dim", "cell"]].assign(kind=kind)
        for c, dtype in (("ids", "<i8"), ("labels", "<i8")):
            row[f"head_{c}"] = [np.concatenate([getattr(p, c) for p in parts]).astype(dtype).tobytes()]
        return row.assign(head_vectors=[np.concatenate([p.whole.astype(kind) for p in parts]).tobytes()]).rename(columns={"kind": "head_kind"})

    heads = found.groupBy("dim", "cell").applyInPandas(merged, "dim int, cell int, head_kind string, head_ids binary, head_labels binary, head_vectors binary")
    return heads, found.select("dim", "cell", "block", "top")


def _search(anchors: DataFrame, slots: DataFrame, blocks: DataFrame, heads: DataFrame, reach: DataFrame, k: int, same: bool, window: tuple[int, int] | None, middles: dict, name: str) -> DataFrame:
    """(anchors, slot, rank, id, score), a table: the k best of each slot (anchors, slot, at, score) by the lists."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        pdf = pdf.sort_values("slot")
        low, high = np.full(n, _NONE), np.full(n, _ALL)
        if window is not None:
            score = pdf["score"].to_numpy(np.int64)
            low, high = -_share(-score, window[0]), _share(score, window[1])
        return pd.DataFrame([{"anchors": pdf["anchors"].iloc[0], "slots": pdf["slot"].to_numpy(np.int64).tobytes(), "at": pdf["at"].to_numpy(np.int64).tobytes(), "low": low.tobytes(), "high": high.tobytes()}])

    def parts(row) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        middle = middles.get(int(row["dim"]))
        return Block(row), *(np.frombuffer(row[c], "<i8") for c in ("at", "low", "high")), None if middle is None else middle[int(row["cell"])]

    def seed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for _, row in pdf.iterrows():
                own, at, low, high, centre = parts(row)
                if row["head_ids"] is not None:
                    head = Block({c: row[f"head_{c}"] for c in ("ids", "labels", "vectors", "kind")})
                    low = walk(own, head, at, low, high, k, same, centre, row["spread"])[3]
                live = low <= high
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(own.norms[at] > 0, (low - SLACK) / own.norms[at], np.where(low > 0, np.inf, -np.inf))[live].min(initial=np.inf)
                out.append({**{c: row[c] for c in columns}, "low": low.tobytes(), "least": least})
            yield pd.DataFrame(out, columns=[*columns, "least"])

    columns = ["anchors", "dim", "cell", "ids", "labels", "vectors", "kind", "spread", "slots", "at", "low", "high"]
    packed = slots.groupBy("anchors").applyInPandas(pack, "anchors string, slots binary, at binary, low binary, high binary")
    asked = anchors.join(packed, "anchors").join(heads, ["dim", "cell"], "left")
    seeded = materialize(asked.mapInPandas(seed, f"anchors string, {_BLOCK}, spread double, slots binary, at binary, low binary, high binary, least double"), f"{name}-asked", 4)
    groups = max(1, seeded.count() // TOGETHER)
    pairs = seeded.select("anchors", "dim", "cell", "least").join(reach, ["dim", "cell"]).where("top >= least")
    pairs = materialize(pairs.select("anchors", "block", F.pmod(F.xxhash64("anchors"), F.lit(groups)).alias("turn")), f"{name}-pairs")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            cands = Block(right.iloc[0])
            for _, row in left.iterrows():
                own, at, low, high, centre = parts(row)
                slot, ids, scores, _, work = walk(own, cands, at, low, high, k, same, centre, row["spread"])
                found.append(pd.DataFrame({"anchors": row["anchors"], "slot": np.frombuffer(row["slots"], "<i8")[slot], "id": ids, "score": scores, "work": 0}))
                found.append(pd.DataFrame({"anchors": [row["anchors"]], "slot": [-1], "id": [0], "score": [0], "work": [work]}))
        return pd.concat(found) if found else pd.DataFrame({"anchors": [], "slot": [], "id": [], "score": [], "work": []})

    left = pairs.join(seeded.drop("least"), "anchors").groupBy("block", "turn")
    right = blocks.join(pairs.select("block", F.col("turn").alias("turn")).distinct(), "block").groupBy("block", "turn")
    found = materialize(left.cogroup(right).applyInPandas(meet, "anchors string, slot long, id long, score long, work long"), f"{name}-found")
    rank = F.row_number().over(Window.partitionBy("anchors", "slot").orderBy(F.desc("score"), "id"))
    out = found.where("slot >= 0").withColumn("rank", rank).where(F.col("rank") <= k).select("anchors", "slot", "rank", "id", "score")
    out._work = found  # what tests measure the walk by
    return out


def mine(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 1.0, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which `anchor` holds.

    A score is the inner product of two vectors whose components are floor(scale * x), an exact whole
    number; higher ones come first, then lesser vec_ids. An anchor's positives are its first
    `positives` other rows with its label, or all. For each anchor and positive the first `negatives`
    rows of other labels whose score is from window[0] to window[1] percent of the positive's are
    returned, or all; ranks start from 1.

    Rows without a vec_id or a label, and vectors that are null or empty or hold a null, NaN or
    infinite component, take no part; neither do vectors whose length after scaling is 2^31 or more,
    as their products need not fit a long. Vectors of different lengths have no score. Another row is
    one with another vec_id; rows that repeat a vec_id are rows of their own, as candidates and as
    anchors. vec_id and label must hold whole numbers, anything else is an error. Other columns are
    read only by `anchor`. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole_number(vectors, vec_id, label)
    usable = "id is not null and label is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vector")).where(F.coalesce(F.expr(usable), F.lit(False)))
    middles = _fit(rows, scale)
    whole = materialize(_quantised(rows, scale, middles).withColumn("row", F.monotonically_increasing_id()), "whole-vectors", 4096)
    blocks = _blocks(whole, F.greatest(F.lit(1), F.lit(BLOCK_NUMBERS) / F.col("dim")), "block")
    anchors = _blocks(whole.where("anchor"), F.lit(ANCHORS), "anchors", middles)
    spreads = {(r.dim, r.cell): r.spread for r in anchors.groupBy("dim", "cell").agg(F.max("spread").alias("spread")).collect()} if middles else {}
    heads, reach = _lists(blocks, spreads, middles)

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, ids in zip(pdf["anchors"], pdf["ids"]):
                own = np.frombuffer(ids, "<i8")
                yield pd.DataFrame({"anchors": name, "slot": np.arange(len(own)), "anchor_id": own})

    of = materialize(anchors.select("anchors", "ids").mapInPandas(members, "anchors string, slot long, anchor_id long"), "anchor-slots")
    near = _search(anchors, of.select("anchors", "slot", F.col("slot").alias("at"), F.lit(0).cast("long").alias("score")), blocks, heads, reach, positives, True, None, middles, "positives")
    pairs = materialize(near.select("anchors", (F.col("slot") * positives + F.col("rank") - 1).alias("slot"), F.col("slot").alias("at"), "score", F.col("id").alias("positive_id")), "positives")
    found = _search(anchors, pairs.select("anchors", "slot", "at", "score"), blocks, heads, reach, negatives, False, window, middles, "negatives")
    named = pairs.join(of.withColumnRenamed("slot", "at"), ["anchors", "at"]).select("anchors", "slot", "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    out = found.join(named, ["anchors", "slot"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out._work = (near._work, found._work)
    return out


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 50 == 0, scale=256.0)


#: All pairs of an anchor and another row.
OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, cast(list_dot_product(a.e, b.e) AS bigint) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, cast(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS int) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""
