"""Near-duplicate embeddings by sorted projection passes.

Each pass orders the vectors lexicographically by a key of concatenated random hashes (the signed
largest coordinate of random projections) and compares every vector with its next neighbours in
that order, a bounded window. Windows go by a row's place in the order, whatever the partitions.
Of the verified pairs a task returns a spanning forest, and those of all passes are united to
groups.

The number of passes follows from the number of vectors, so that a pair at the limit is missed with a
stated probability if vectors are evenly spread. Then rounds of further passes follow, each judged by
the pairs of groups that it joins, so by pairs that all passes before had missed: links within groups,
of which easy copies make up most, don't count. As such joins die away round by round, they tell how
many are left; rounds go on until that is a small share of all joins of these rounds.

Since a window is bounded, it doesn't count links; so in each group every member is compared with
every other, in blocks that Spark deals out, and only counts leave a block. Equal vectors are one
representative with a weight throughout, and vectors are never keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .runtime import discard, join_hot, materialize, ship, table, whole_number

#: Coordinates of the projections whose signed largest one is a digit of the key, first to last.
DIGITS = (64, 32, 8, 8)
#: Neighbours in the order of a pass that a vector is compared with at least, and such windows in one block.
WINDOW, BLOCK_WINDOWS = 128, 64
#: Probability that all passes miss a pair at the limit among evenly spread vectors, and the share of the
#: joins of further rounds that may be left.
MISS, LEFT = 0.001, 0.02
#: Passes whose rows stand on disk at the same time.
ROUND = 12
#: Sorted rows in a range partition, and vectors in an Arrow batch.
RANGE_ROWS, BATCH = 1_000_000, 4096
#: Vectors of a group in one block: SMALL in groups of up to SPREAD blocks of them, LARGE in those that need more than SPREAD blocks even so.
SMALL, SPREAD, LARGE = 128, 16, 2048


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _digit(x: np.ndarray) -> np.ndarray:
    at = np.abs(x).argmax(1)
    return 2 * at + (x[np.arange(len(x)), at] > 0)


@lru_cache(256)
def _projections(dim: int, number: int, seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([seed, dim, number]))
    return [rng.standard_normal((dim, min(dim, m))) for m in DIGITS], rng.standard_normal(dim)


def sort_key(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    """The key of each unit vector in pass `number`: its digits, and a fine projection to order equal ones."""
    projections, fine = _projections(x.shape[1], number, seed)
    key = np.zeros(len(x), np.int64)
    for p in projections:
        key = key * (2 * p.shape[1]) + _digit(x @ p)
    return key * 1024 + np.clip(x @ fine * 64 + 512, 0, 1023).astype(np.int64)


def passes_needed(n: int, dim: int, least: float, miss: float = MISS) -> int:
    """Passes after which a pair of cosine `least` among n evenly spread vectors is missed with probability `miss`.

    Such a pair agrees in a digit of m values with probability p, any other pair with 1 / m. A window
    spans the digits that leave about WINDOW of n rows, so a pass finds it with probability
    (n / WINDOW) ** (ln p / ln m), less a tenth for ends of windows. p is estimated by simulation.
    """
    rng = np.random.Generator(np.random.PCG64(dim))
    x, y = rng.standard_normal((2, 4000, dim))
    x = _unit(x)
    y -= (x * y).sum(1, keepdims=True) * x
    if dim > 1:
        y = _unit(y)
    p, _ = _projections(dim, 0, 0)
    same = _digit(x @ p[0]) == _digit((least * x + math.sqrt(max(0.0, 1 - least * least)) * y) @ p[0])
    share = min(max(float(same.mean()), 0.05), 0.99)
    found = 0.9 * max(1.0, n / WINDOW) ** (math.log(share) / math.log(2 * p[0].shape[1]))
    return math.ceil(math.log(miss) / math.log(1 - found))


def _linked(x: np.ndarray, y: np.ndarray, short_x: np.ndarray, short_y: np.ndarray, least: float) -> np.ndarray:
    """Whether the unit vectors of x and y have cosine >= least: in single precision, and in double
    precision where that is within its error of the limit."""
    error = (x.shape[1] + 4) * 2.0**-23  # twice the bound of a product in single precision
    sims = short_x @ short_y.T
    if sims.max(initial=-2) < least - error:
        return np.zeros(sims.shape, bool)
    out = sims > least + error
    i, j = np.nonzero(~out & (sims >= least - error))
    for k in np.array_split(np.arange(len(i)), math.ceil(len(i) / 16384) or 1):
        out[i[k], j[k]] = np.einsum("ij,ij->i", x[i[k]], y[j[k]]) >= least
    return out


def _roots(a: np.ndarray, b: np.ndarray, top: np.ndarray) -> np.ndarray:
    """top (the least known of each place), after the edges (a, b)."""
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            return top
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]


def _vectors(column: pd.Series, kind: str, dim: int) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(column), kind).reshape(-1, dim).astype(np.float64))


def _forest(pdf: pd.DataFrame, least: float, kind: str) -> pd.DataFrame:
    """A spanning forest of the links in the windows of one block of an order (at, id, dim, vector)."""
    found = [pdf[["id", "id"]].iloc[:0].set_axis(["a", "b"], axis=1)]
    pdf = pdf.sort_values("at")
    for dim, rows in pdf.groupby("dim", sort=False):
        x = _vectors(rows["vector"], kind, int(dim))
        short, ids, top = x.astype(np.float32), rows["id"].to_numpy(), np.arange(len(x))
        for s in range(0, len(x), WINDOW):
            e = s + 2 * WINDOW
            i, j = np.nonzero(np.triu(_linked(x[s : s + WINDOW], x[s:e], short[s : s + WINDOW], short[s:e], least), 1))
            top = _roots(s + i, s + j, top)
        own = np.flatnonzero(ids != ids[top])  # a vector stands in many orders
        found.append(pd.DataFrame({"a": ids[own], "b": ids[top[own]]}))
    return pd.concat(found).drop_duplicates()


def _pass_links(reps: DataFrame, first: int, last: int, least: float, seed: int, kind: str) -> DataFrame:
    """Links (a, b) of reps (id, dim, vector) found by passes first to last - 1, a table."""
    spark = reps.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                rows = pa.array(np.flatnonzero(dims == dim))
                ids, n = batch.column(0).take(rows), len(rows)
                x = _vectors(batch.column(2).take(rows).to_pylist(), kind, int(dim))
                for p in range(first, last):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, p, np.int32)), pa.array(sort_key(x, p, seed)), ids], names=["dim", "pass", "key", "id"])

    keys = materialize(reps.select("id", "dim", "vector").mapInArrow(keyed, "dim int, pass int, key long, id long"), "vector-keys", BATCH)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(keys.count() / RANGE_ROWS))
    order = ["dim", "pass", "key", "id"]
    # the number that Spark gives a sorted row holds its partition above bit 33 and its place in it below
    ranged = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", F.monotonically_increasing_id().alias("n"))
    ranged = materialize(ranged.select("id", F.shiftright("n", 33).alias("part"), F.col("n").bitwiseAND((1 << 33) - 1).alias("n")), "vector-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = ranged.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    placed = ranged.join(F.broadcast(starts), "part").select("id", (F.col("start") + F.col("n")).alias("at"))
    per = WINDOW * BLOCK_WINDOWS
    # the first window of a block also ends the block before, so that no neighbours are parted
    homes = F.when((F.col("at") % per < WINDOW) & (F.col("at") >= per), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = placed.select("id", "at", F.explode(homes).alias("back")).groupBy("id").agg(F.collect_list(F.struct("at", "back")).alias("homes"))
    dealt = reps.select("id", "dim", "vector").join(dealt, "id").select("id", "dim", "vector", F.explode("homes").alias("h"))
    dealt = dealt.select("id", "dim", "vector", F.col("h.at").alias("at"), (F.floor(F.col("h.at") / per) - F.col("h.back")).alias("block"))
    links = materialize(dealt.groupBy("block").applyInPandas(lambda pdf: _forest(pdf, least, kind), "a long, b long"), "vector-links")
    discard(keys, ranged)
    return links


def _joined(groups: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """groups (id, component) after more links, and how many pairs of groups these joined."""
    of = lambda end, out: groups.select(F.col("id").alias(end), F.col("component").alias(out))
    ends = links.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    ends = materialize(ends.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "vector-ends")
    new = ends.count()
    if not new:
        return groups, 0
    more = connected_components(ends, "x", "y", name="vector-merged")
    grown = groups.join(more.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    fresh = more.join(groups.select("id"), "id", "left_anti").select("id", "component")
    return materialize(grown.unionByName(fresh), "vector-groups"), new


def settled(joins: list[int]) -> bool:
    """Whether rounds that joined so many pairs of groups, one after another, leave at most a share LEFT of such joins.

    Joins fall from round to round by the share of pairs that a round misses; what is left is the sum of the rest of that row.
    """
    if not joins[-1]:
        return True
    if len(joins) < 2:
        return False
    falls = min(joins[-1] / max(joins[-2], 1), 0.95)
    return joins[-1] * falls / (1 - falls) <= LEFT * sum(joins)


def _groups(reps: DataFrame, least: float, seed: int, kind: str) -> DataFrame:
    """(id, component) of the representatives that are linked, by as many passes as it takes."""
    n, *dims = reps.agg(F.count("*"), F.min("dim"), F.max("dim"), F.mode("dim")).first()
    if n < 2:
        return reps.select("id", F.col("id").alias("component")).limit(0)
    needed = max(passes_needed(n, d, least) for d in set(dims))
    check = max(2, needed // 4)
    done, links = 0, None
    while done < needed - check:
        upto = min(done + ROUND, needed - check)
        found = _pass_links(reps, done, upto, least, seed, kind)
        links, done = found if links is None else links.unionByName(found), upto
    groups = connected_components(links, name="vector-components") if links is not None else reps.select("id", F.col("id").alias("component")).limit(0)
    joins: list[int] = []
    while not joins or not settled(joins):
        groups, new = _joined(groups, _pass_links(reps, done, done + check, least, seed, kind))
        joins.append(new)
        done += check
    return groups


def _block_counts(pdf: pd.DataFrame, least: float, kind: str) -> pd.DataFrame:
    """Weighted links of each id in pairs of blocks (group, x, y, block, id, weight, dim, vector)."""
    ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for (_, x, y, dim), rows in pdf.groupby(["group", "x", "y", "dim"], sort=False):
        v = _vectors(rows["vector"], kind, int(dim))
        own, weight = rows["id"].to_numpy(), rows["weight"].to_numpy(np.int64)
        sides = [np.arange(len(v))] if x == y else [np.flatnonzero(rows["block"] == s) for s in (x, y)]
        a, b = sides[0], sides[-1]
        linked = _linked(v[a], v[b], v[a].astype(np.float32), v[b].astype(np.float32), least)
        if x == y:
            np.fill_diagonal(linked, False)
        else:
            ids.append(own[b])
            counts.append(weight[a] @ linked)
        ids.append(own[a])
        counts.append(linked @ weight[b])
    return pd.DataFrame({"id": np.concatenate(ids), "n": np.concatenate(counts)})


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.9, seed: int = 1) -> DataFrame:
    """One row per row of vectors: (vec_id, n_links, component_id, kept).

    Two vectors are linked if their cosine, in double precision, is `least` or more. n_links counts
    the other rows linked directly, component_id is the least vec_id reachable, the own one
    included, and kept tells whether that is the row's own. Vectors that are null, empty or zero or
    hold null, NaN or infinite components are linked with nothing; neither are vectors of different
    lengths, nor rows without a vec_id, whose component_id is null and which are kept. Rows that
    repeat a vec_id are vectors of their own. vec_id must hold whole numbers; anything else is an
    error. Other columns are not read; an empty table gives an empty table.
    """
    ship(vectors.sparkSession)
    whole_number(vectors, vec_id)
    kind = "<f4" if vectors.select(vector).schema[0].dataType.simpleString() == "array<float>" else "<f8"
    usable = "coalesce(id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0), false)"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("vector"))
    rows = materialize(rows.withColumn("usable", F.expr(usable)).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # equal vectors by a digest of 128 bits
    good = rows.where("usable").select("row", "id", F.xxhash64("vector").alias("p"), F.xxhash64(F.lit(1), "vector").alias("q"))
    classes = materialize(good.groupBy("p", "q").agg(F.min("row").alias("rep"), F.min("id").alias("id"), F.count("*").alias("weight")), "vector-classes")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.append(0, np.cumsum(batch.column(1).value_lengths().to_numpy())) * np.dtype(kind).itemsize
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([values[i:j] for i, j in zip(ends[:-1], ends[1:])], pa.binary()), pa.array(np.diff(ends) // np.dtype(kind).itemsize, pa.int32())], names=["id", "vector", "dim"])

    chosen = rows.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "vector")
    reps = materialize(chosen.mapInArrow(packed, "id long, vector binary, dim int"), "vector-reps", BATCH)
    groups = _groups(reps, least, seed, kind)

    members = classes.select("rep", F.col("id").alias("least"), "weight").join(groups.select(F.col("id").alias("rep"), F.col("component").alias("group")), "rep")
    members = materialize(members, "vector-grouped")
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), F.min("least").alias("component"))
    members = materialize(join_hot(members, sizes, ["group"], "n"), "vector-members")
    blocks = F.greatest(F.least(F.ceil(F.col("n") / SMALL), F.lit(SPREAD)), F.ceil(F.col("n") / LARGE)).cast("long")
    dealt = members.join(reps.select(F.col("id").alias("rep"), "dim", "vector"), "rep").withColumn("blocks", blocks)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", F.col("rep").alias("id"), "weight", "dim", "vector")
    # small groups share a task, a pair of blocks of a large one goes to a task of its own if there are enough
    bins = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(members.count() / LARGE))
    counted = dealt.withColumn("bin", F.pmod(F.xxhash64("group", "x", "y"), F.lit(bins))).groupBy("bin").applyInPandas(lambda pdf: _block_counts(pdf, least, kind), "id long, n long")
    counted = materialize(counted.groupBy("id").agg(F.sum("n").alias("links")), "vector-counts")

    figures = classes.join(members.select("rep", "component"), "rep", "left").join(counted.withColumnRenamed("id", "rep"), "rep", "left")
    figures = figures.select("p", "q", "weight", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    out = join_hot(good, materialize(figures, "vector-figures"), ["p", "q"], "weight").select("id", "links", "component")
    out = out.unionByName(rows.where("not usable").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(vec_id), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector: vec_id, n_links, component_id, kept."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs by their definition, and the components of their links.
OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, cast(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reached AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reached r JOIN l ON l.a = r.b),
least AS (SELECT a, least(a, min(b)) AS component FROM reached GROUP BY a),
links AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(links.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM v LEFT JOIN links ON links.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
