"""A stored index for approximate cosine search (R3, S13): coarse lists, product-quantised codes, exact rescoring.

A vector of length 1 goes to the list of its nearest coarse centre; what is left of it is cut into
pieces, and each is replaced by the number of its nearest code word, one byte a piece. A query is
compared with what centre and code words stand for; only the short list of the best by that is scored
exactly. Lists are folders of Parquet files, so that a search reads those that its queries ask for, and
none of the others. Queries and rows travel in bundles of bounded size, rows by the hash of their id:
each bundle is an even sample of all lists and gets its share of the short list, and only the k best leave it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine, l2_normalize
from .retrieval import LEAST_BLOCK, NUMBERS_BLOCK, _block, _core_blocks, _unit, _whole, kmeans, knn_topk, nearest, rank_candidates

#: Vectors that centres and code words are fitted on at most, code words of a piece, numbers in a piece, rows of a bundle at most, on average.
TRAINING, WORDS, PIECE, BUNDLE_ROWS = 65_536, 256, 4, 65_536
#: Vectors that a search is tuned on, at most.
TUNING = 256


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres (list, dim) and code words (piece, word, number) for unit vectors of one length."""

    centres: np.ndarray
    words: np.ndarray

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each unit vector, nearest first."""
        if n == 1:
            return nearest(x, self.centres)[:, None]
        near = x @ self.centres.T - (self.centres**2).sum(1) / 2
        return np.argsort(-near, axis=1, kind="stable")[:, :n]

    def _pieces(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.words.shape
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The code words (bytes) of what is left of each vector without its list's centre."""
        rest = self._pieces(x - self.centres[own])
        return np.stack([nearest(rest[:, i], words) for i, words in enumerate(self.words)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The vectors that code words in these lists stand for, in single precision."""
        m, _, width = self.words.shape
        rest = self.words[np.arange(m), codes].reshape(len(codes), m * width)
        return (self.centres[own] + rest[:, : self.centres.shape[1]]).astype(np.float32)

    def compare(self, x: np.ndarray, codes: np.ndarray, own: np.ndarray, probes: int):
        """Of 64 unit vectors at a time: their numbers, the index rows in any of their nearest lists, and approximate
        scores with these; those in lists that a vector doesn't ask are -inf."""
        rows = self.decode(codes, own)
        by_list = np.concatenate([nearest(x[at : at + 64], self.centres) for at in range(0, len(x), 64)]).argsort(kind="stable")
        for at in range(0, len(x), 64):
            of = by_list[at : at + 64]
            asked = np.zeros((len(of), len(self.centres)), bool)
            np.put_along_axis(asked, self.lists(x[of], probes), True, 1)
            met = np.flatnonzero(asked.any(0)[own])
            scores = x[of].astype(np.float32) @ (rows if len(met) == len(rows) else rows[met]).T
            scores[~asked[:, own[met]]] = -np.inf
            yield of, met, scores


def train(kb: DataFrame, vector: str = "vector", lists: int | None = None) -> Quantiser:
    """A quantiser for kb(id, vector), fitted on at most TRAINING vectors, the first by a hash of the id.

    By default as many lists as the square root of the number of vectors, 65,536 at most. Vectors of
    the commonest length count; an error if there is none.
    """
    rows = _whole(kb, "id", vector)
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        raise ValueError("no vectors to fit an index on")
    dim, n = sizes[0].dim, sizes[0].n
    hashed = rows.where(F.col("dim") == dim).withColumn("h", F.xxhash64("key"))
    last = hashed.select("h").orderBy("h").limit(TRAINING).agg(F.max("h")).first()[0]
    x = _unit(np.array(sorted(r.v for r in hashed.where(F.col("h") <= F.lit(last)).select("v").limit(TRAINING).collect()), float))
    lists = lists or min(65_536, max(1, round(math.sqrt(n))), max(1, len(x) // 4))
    centres = kmeans(x, min(lists, len(x)), unit=False)
    rest = x - centres[nearest(x, centres)]
    m = math.ceil(dim / PIECE)
    rest = np.pad(rest, ((0, 0), (0, m * PIECE - dim))).reshape(len(x), m, PIECE)
    words = []
    for i in range(m):
        own = kmeans(rest[:, i], min(WORDS, len(x)), unit=False)
        words.append(np.vstack([own, np.repeat(own[:1], WORDS - len(own), 0)]))
    return Quantiser(centres, np.stack(words))


def encode(kb: DataFrame, quantiser: Quantiser, vector: str = "vector") -> DataFrame:
    """(id, vector, code, list): the index rows of kb(id, vector); vectors of length 1. Vectors that the
    quantiser has no length for, and null, empty or infinite ones, are left out."""
    dim = quantiser.centres.shape[1]

    @F.pandas_udf("struct<list:int,code:binary>")
    def run(column: pd.Series) -> pd.DataFrame:
        x = np.stack(column.to_numpy()).astype(float)
        own = quantiser.lists(x, 1)[:, 0]
        return pd.DataFrame({"list": own.astype(np.int32), "code": [c.tobytes() for c in quantiser.encode(x, own)]})

    rows = _whole(kb, "id", vector).where(F.col("dim") == dim).select(F.col("key").alias("id"), l2_normalize("v").alias("vector"))
    return rows.withColumn("_c", run("vector")).select("id", "vector", "_c.code", "_c.list")


def _counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("list").agg(F.count("*").alias("n"))


def write(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Index rows as one folder for each list; large lists are several files, small ones share a task."""
    dealt = rows.withColumn("_s", F.xxhash64("id")).repartitionByRange("list", "_s").drop("_s")
    dealt.sortWithinPartitions("list", "id").write.mode(mode).partitionBy("list").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """More rows for a stored index; an error unless every list has grown by just its share of them."""
    spark = rows.sparkSession
    before = {r["list"]: r.n for r in _counts(spark, path).collect()}
    new = {r["list"]: r.n for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}
    write(rows, path, "append")
    after = {r["list"]: r.n for r in _counts(spark, path).collect()}
    wrong = sorted(k for k in after.keys() | new.keys() if after.get(k, 0) != before.get(k, 0) + new.get(k, 0))
    if wrong:
        raise ValueError(f"lists {wrong[:10]} did not grow by their new rows")


def read(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """A stored index; an error if it holds another number of rows than count."""
    rows = spark.read.parquet(path)
    if count is not None and rows.count() != count:
        raise ValueError(f"the index doesn't hold {count} rows")
    return rows


def probed(queries: DataFrame, quantiser: Quantiser, probes: int, vector: str = "vector") -> DataFrame:
    """(qid, v, list): queries(qid, vector) once for each of their nearest lists."""

    @F.pandas_udf("array<int>")
    def near(column: pd.Series) -> pd.Series:
        return pd.Series(list(quantiser.lists(_unit(np.stack(column.to_numpy()).astype(float)), probes).astype(np.int32)))

    rows = _whole(queries, "qid", vector).where(F.col("dim") == quantiser.centres.shape[1])
    return rows.select(F.col("key").alias("qid"), F.col("v").cast("array<double>").alias("v"), F.explode(near("v")).alias("list"))


def asked_lists(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of a stored index in lists that are asked for; the folders of others aren't read (a list for each row of the small side)."""
    return index.join(F.broadcast(asked.where("list >= 0").select("list").distinct()), "list")


def _bundles(index: DataFrame, quantiser: Quantiser) -> int:
    """How many bundles the rows of an index travel in."""
    n = index.count()
    return max(1, math.ceil(n * quantiser.centres.shape[1] / NUMBERS_BLOCK), math.ceil(n / BUNDLE_ROWS))


def _meet(queries: DataFrame, index: DataFrame, quantiser: Quantiser, probes: int, k: int, bundles: int, vector: str, *more: str) -> tuple:
    """Bundles of queries (qid, v, ..) and of index rows (id, list, code, vector) in lists that are asked for, grouped so that each one meets all of the other side."""
    dim = quantiser.centres.shape[1]
    rows = _whole(queries, "qid", vector, *more).where(F.col("dim") == dim).select(F.col("key").alias("qid"), F.col("v").cast("array<double>").alias("v"), *more)
    n = rows.count()
    nq = max(_core_blocks(rows, n, bundles, LEAST_BLOCK), math.ceil(n * dim / NUMBERS_BLOCK), math.ceil(n * k / NUMBERS_BLOCK))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumn("x", _block("qid", nq)).withColumn("y", upto(bundles))
    right = asked_lists(index, probed(queries, quantiser, probes, vector)).select("id", "list", "code", "vector")
    return left.groupBy("x", "y").cogroup(right.withColumn("y", _block("id", bundles)).withColumn("x", upto(nq)).groupBy("x", "y"))


def _arrays(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame, np.ndarray, np.ndarray]:
    """Unit vectors of queries, index rows by id, their codes and their lists."""
    right = right.sort_values("id")
    codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
    return _unit(np.stack(left["v"].to_numpy()).astype(float)), right, codes, right["list"].to_numpy(np.int64)


def search(queries: DataFrame, index: DataFrame, quantiser: Quantiser, k: int, probes: int | None = None, shortlist: int | None = None, vector: str = "vector") -> DataFrame:
    """(qid, rank, id, score): approximate cosine top-k of queries(qid, vector) in index rows.

    probes: lists that a query looks into; by default a quarter of them, at least 32 and at most 256.
    shortlist: candidates that a query scores exactly, 10 k by default and k of each bundle at least; bundles
    get equal shares of it, one row at least. Scores are exact.
    """
    n = len(quantiser.centres)
    probes = min(n, probes or min(256, max(32, n // 4)))
    bundles = _bundles(index, quantiser)
    share = max(1, (shortlist or max(10 * k, bundles * k)) // bundles)
    qid_type, id_type = queries.schema["qid"].dataType.simpleString(), index.schema["id"].dataType.simpleString()

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], "id": [], "score": []}
        if len(left) and len(right):
            x, right, codes, own = _arrays(left, right)
            qids, ids, v = left["qid"].to_numpy(), right["id"].to_numpy(), np.stack(right["vector"].to_numpy())
            for of, met, scores in quantiser.compare(x, codes, own, probes):
                if share < len(met):
                    least = np.partition(scores, -share, axis=1)[:, -share] - 1e-6  # equal codes may differ by rounding
                else:
                    least = np.full(len(of), -np.inf)
                for q, row, floor in zip(of, scores, least):
                    best = np.flatnonzero(row >= max(floor, -1e9))
                    if len(best) > share:
                        best = best[np.lexsort((best, -np.round(row[best], 5)))[:share]]
                    exact = np.round(v[met[best]] @ x[q], 9)
                    first = np.lexsort((met[best], -exact))[:k]
                    out["qid"].append(np.repeat(qids[q : q + 1], len(first)))
                    out["id"].append(ids[met[best][first]])
                    out["score"].append(exact[first])
        return pd.DataFrame({c: np.concatenate(parts) if parts else [] for c, parts in out.items()})

    found = _meet(queries, index, quantiser, probes, k, bundles, vector).applyInPandas(near, f"qid {qid_type}, id {id_type}, score double")
    return rank_candidates(found, k=k).select("qid", "rank", "id", "score")


def tune(index: DataFrame, quantiser: Quantiser, k: int, most: int, recall: float = 0.95) -> tuple[int, int]:
    """(probes, shortlist) with which a search in index rows finds this share of the k nearest others, measured on at most TUNING of its vectors.

    The vectors are the first by a hash of the id; their exact neighbours are found among all rows. Probes are
    the lists in which so many of these lie, and the short list, 10 k and k of each bundle at least and `most` at most,
    is as long as it takes for so many of them to be within the bundles' shares.
    """
    hashed = index.select("id", "vector").withColumn("h", F.xxhash64("id", F.lit("tune")))
    last = hashed.select("h").orderBy("h").limit(TUNING).agg(F.max("h")).first()[0]
    n, bundles = len(quantiser.centres), _bundles(index, quantiser)
    least = max(1, min(max(10 * k, bundles * k), most))
    if last is None:
        return n, least
    x = {r.id: r.vector for r in hashed.where(F.col("h") <= F.lit(last)).limit(TUNING).collect()}
    schema = index.select(F.col("id").alias("qid"), "vector").schema
    asked = index.sparkSession.createDataFrame(list(x.items()), schema)
    near = knn_topk(asked, index, k + 1).where("qid != id").select("qid", "id", "rank").join(index.select("id", "list"), "id").collect()
    exact = {}
    for r in sorted(near, key=lambda r: r["rank"]):
        exact.setdefault(r.qid, []).append((r.id, r["list"]))
    exact = {q: own[:k] for q, own in exact.items()}
    if not exact:
        return n, least
    order = quantiser.lists(_unit(np.array([x[q] for q in exact])), n)
    need = sorted(int(np.flatnonzero(near_lists == at)[0]) for near_lists, own in zip(order, exact.values()) for _, at in own)
    wanted = math.ceil((1 + recall) / 2 * len(need))  # half of what may be missed is left to the short list
    probes = need[wanted - 1] + 1

    def places(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of each neighbour in a bundle the place among the rows that the query compares there."""
        out = []
        if len(left) and len(right):
            x, right, codes, own = _arrays(left, right)
            at = {i: n for n, i in enumerate(right["id"].tolist())}
            for of, met, scores in quantiser.compare(x, codes, own, probes):
                column = {n: c for c, n in enumerate(met.tolist())}
                for q, row in zip(of, scores):
                    found = [row[column[at[i]]] for i in left["ids"].iloc[q] if at.get(i) in column]
                    out += [int((row > s + 1e-6).sum()) + 1 for s in found if s > -np.inf]
        return pd.DataFrame({"place": out})

    known = index.sparkSession.createDataFrame([(q, x[q], [i for i, _ in own]) for q, own in exact.items()], schema.add("ids", T.ArrayType(index.schema["id"].dataType)))
    found = sorted(r.place for r in _meet(known, index, quantiser, probes, k, bundles, "vector", "ids").applyInPandas(places, "place long").collect())
    wanted = math.ceil(recall * len(need))
    shortlist = bundles * found[wanted - 1] if wanted <= len(found) else most
    return probes, min(max(least, shortlist), most)
