"""Near-duplicate documents by SetSketch registers.

Each document's set of word shingles is summed up in registers: register i holds the truncated,
exponentially spaced logarithm of the least of the shingles' exponentially distributed values
under the i-th hash. Sketches merge by taking the larger registers, and two sets agree in a
register about as often as they overlap. Bands of register values give candidates; the joint
likelihood of the two sketches and the known set sizes estimates the similarity; pairs that may
reach the threshold are compared on their full sets. Full sets hold 64-bit hashes of words under a key
that is drawn anew in each run, so no texts can be written to collide; sketches, which only choose
what is compared, have a fixed family of their own.

Groups of copies are never expanded into pairs:
* equal sets are one representative,
* first every member of a band's bucket is compared with one centre of that bucket: the member
  that meets most others in all its buckets, which is the text that the others were made from
  if there is one,
* then only members of a bucket that the verified links have not joined yet are compared with
  each other, in pairs of blocks of bounded size. Such a task first compares sketches and keeps
  members that have a likely partner; a second one compares full sets and gives a spanning forest
  of the links that it finds. So no pair of a bucket stays undecided, and what leaves a task grows
  with the members, not with their pairs.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .kernels import BLANK, SLICE, Words, encoded, mix, ragged, shingles, slices, small
from .runtime import discard, materialize, ship, table, whole_number

#: Bands and registers in a band: a pair of similarity 0.8 meets in a band with probability 0.99995.
BANDS, ROWS = 25, 5
REGISTERS = 128
#: Base, rate and number of values of the registers (two bytes each).
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Log-likelihood by which a similarity at the threshold may fall behind the best estimate.
SLACK = 8.0
#: Equal registers that a pair needs to be compared at all; at similarity 0.8 fewer come with probability 4e-5.
LEAST_EQUAL = 84
#: Family of the word hashes of full sets, under a run's key; the sketches' is 0, without one.
CONFIRM = 1
#: Members of a bucket in one block.
BLOCK = 2048
#: Distinct ids up to which they are broadcast (8 bytes each).
BROADCAST_IDS = 100_000

_rng = np.random.Generator(np.random.PCG64(8))
_XOR = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)
_MUL = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(h: np.ndarray) -> np.ndarray:
    """The SetSketch registers (uint16) of a set of hashes."""
    least = np.full(REGISTERS, ~np.uint64(0))
    for at in range(0, len(h), 2048):
        part = h[at : at + 2048]
        np.minimum(least, ((part[None, :] ^ _XOR[:, None]) * _MUL[:, None]).min(1), out=least)
    x = -np.log1p(-(least.astype(float) + 0.5) / 2.0**64) / RATE  # exponential, of rate RATE for one element
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(r: np.ndarray) -> np.ndarray:
    """A long for each band of a sketch."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + r[j * BANDS : (j + 1) * BANDS].astype(np.uint64))
    return out.view(np.int64)


def similarity_likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, at: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of sketches: the most likely Jaccard similarity, and by how much its
    log-likelihood exceeds that of the similarity `at`.

    A register of the first set is larger than the second's with probability p(u - v J), smaller
    with p(v - u J), where u and v are the sets' shares of n_a + n_b, J the similarity, and
    p(x) = -log_b(1 - x (b - 1) / b).
    """
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = REGISTERS - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.append(np.linspace(0, 1, 201), at)[None, :]
    j = np.minimum(grid, most)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    ll = more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))
    best = ll[:, :-1].argmax(1)
    rows = np.arange(len(a))
    return np.minimum(grid[0, best], most[:, 0]), ll[rows, best] - ll[:, -1]


def _sets(texts: list[bytes], k: int, family: int = 0, key: bytes = b"") -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j in slices([len(x) for x in texts], SLICE // 2):
        w = Words(texts[i:j], BLANK, family=family, key=key)
        for d in range(j - i):
            yield np.unique(shingles(w.hash[w.bounds[d] : w.bounds[d + 1]], k))


def _sketches(docs: DataFrame, k: int, key: bytes) -> DataFrame:
    """(id, n, set_id, bands, sketch) for each row; set_id and sketch are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n, set_id, bands, sketch = [], [], [], []
            texts = encoded(batch.column(1))
            for s, other in zip(_sets(texts, k), _sets(texts, k, CONFIRM, key), strict=True):
                n.append(len(other))
                if len(other):
                    r = registers(s)
                    set_id.append(hashlib.blake2b(s.tobytes() + other.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(r))
                    sketch.append(r.tobytes())
                else:
                    set_id.append(None)
                    bands.append(None)
                    sketch.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(set_id, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["id", "n", "set_id", "bands", "sketch"])

    return docs.mapInArrow(run, "id long, n long, set_id binary, bands array<long>, sketch binary")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs with sketches sa, sb and set sizes na, nb, those that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (2, 3))
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (4, 5))
            j, behind = similarity_likelihood(a, b, na, nb, percent / 100)
            keep = pa.array((j >= percent / 100) | (behind <= SLACK))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"  # no pair of sets whose sizes differ more can reach it
    return pairs.where(fits).select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _item_sets(ids: DataFrame, docs: DataFrame, k: int, key: bytes) -> DataFrame:
    """(id, items): the full shingle sets of the documents with these distinct ids, a table."""
    ids = materialize(ids, "near-candidate-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            values = [s.view(np.int64) for s in _sets(encoded(batch.column(1)), k, CONFIRM, key)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64()))], names=["id", "items"])

    out = materialize(texts.mapInArrow(sets, "id long, items array<long>"), "near-sets")
    discard(ids)
    return out


def _blocks(members: DataFrame) -> DataFrame:
    """Members of buckets, dealt to the pairs (x, y) of their bucket's blocks; many small buckets share a bin."""
    spark = members.sparkSession
    sizes = members.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = members.join(sizes, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), members.count() // (2 * BLOCK))
    return dealt.withColumn("bin", F.pmod(F.xxhash64("band", "key", "x", "y"), F.lit(bins))).drop("blocks", "other")


def _each_block(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """The rows of each pair of blocks, their components, and the side of each row (equal sides within one block)."""
    for (_, _, x, y), rows in pdf.groupby(["band", "key", "x", "y"], sort=False):
        component = rows["component"].to_numpy()
        if len(rows) > 1 and (component != component[0]).any():
            yield rows, component, np.zeros(len(rows), bool) if x == y else (rows["block"] == y).to_numpy()


def _with_likely_partner(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Members with enough registers in common with a member of another component."""
    out = [pdf[["band", "key", "id"]].iloc[:0]]
    for rows, component, side in _each_block(pdf):
        r = np.frombuffer(b"".join(rows["sketch"]), np.uint16).reshape(-1, REGISTERS)
        n = rows["n"].to_numpy()
        likely = np.zeros(len(rows), bool)
        for i in range(len(rows)):
            at = np.flatnonzero((component != component[i]) & ((side != side[i]) | ~side.any()) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            if len(at):
                at = at[(r[at] == r[i]).sum(1) >= LEAST_EQUAL]
                likely[at] = True
        out.append(rows.loc[likely, ["band", "key", "id"]])
    return pd.concat(out).astype({"band": "int32"})


def _forest(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A spanning forest of the verified links between members of different components."""
    a, b = [], []
    for rows, component, side in _each_block(pdf):
        ids = rows["id"].to_numpy()
        n = rows["items"].map(len).to_numpy()
        doc = np.repeat(np.arange(len(rows)), n)
        _, item = np.unique(np.concatenate(list(rows["items"])), return_inverse=True)
        holders = doc[np.argsort(item, kind="stable")]
        first = np.append(0, np.cumsum(np.bincount(item)))
        begins = np.append(0, np.cumsum(n))
        group = {c: c for c in component.tolist()}

        def top(c: int) -> int:
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c

        for i in range(len(rows)):
            both = np.bincount(ragged(holders, first, item[begins[i] : begins[i + 1]])[0], minlength=len(rows))
            near = (100 * both >= percent * (n + n[i] - both)) & (component != component[i]) & ((side != side[i]) | ~side.any())
            for j in np.flatnonzero(near).tolist():
                p, q = top(component[i]), top(component[j])
                if p != q:
                    group[p] = q
                    a.append(ids[i])
                    b.append(ids[j])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, key: bytes) -> DataFrame:
    """Of the pairs (a, b), those whose full shingle sets reach the threshold, a table."""
    pairs = materialize(pairs.distinct(), "near-candidates")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    items = _item_sets(ids, docs, k, key)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keep = []
            x, y = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                p, q = (c[i].values.to_numpy() for c in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    both = pairs.join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    out = materialize(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "near-links")
    discard(pairs, items)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id, kept).

    Words are runs of non-blank characters, A-Z lowered; a set holds the distinct runs of
    `shingle` words, or the whole sequence if it is shorter. Documents with
    100 * |intersection| >= percent * |union| are linked; component_id is the least doc_id
    reachable, the own one included, and kept tells whether that is the row's own. Null, empty
    and blank texts have an empty set and are linked with nothing. Rows that repeat a doc_id are
    taken as one document each and linked through it. A row without a doc_id is linked with nothing,
    either: its component_id is null and it is kept. doc_id must hold whole numbers; anything else is
    an error. Other columns are not read; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    whole_number(docs, doc_id)
    key = os.urandom(16)
    every = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = every.where("id is not null")
    sketched = materialize(_sketches(every, shingle, key), "near-sketches")
    sizes_of = materialize(sketched.select("id", "n"), "near-sizes")
    all_sketches, sketched = sketched, sketched.where("id is not null")
    classes = materialize(sketched.where("set_id is not null").groupBy("set_id").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "near-classes")
    same = materialize(sketched.where("set_id is not null").select("set_id", "id").join(classes.where("copies > 1").select("set_id", "rep"), "set_id").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")), "near-same")
    # the representative's own row; one of them if the row repeats
    reps = sketched.join(classes.select("set_id", F.col("rep").alias("id")), ["set_id", "id"], "left_semi").dropDuplicates(["set_id"])
    reps = materialize(reps.select("id", "n", "bands", "sketch"), "near-reps")
    # what nothing reads any more goes at once; only sizes and components are left in the end
    discard(all_sketches, classes)
    texts = rows

    bare = reps.select("id", F.posexplode("bands").alias("band", "key"))
    sizes = bare.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    # what a bucket's members are joined with is a table first, so that Spark may split the rows of a large bucket
    buckets = materialize(sizes, "near-buckets")
    members = materialize(bare.join(buckets, ["band", "key"]), "near-members")
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    centres = members.join(degree, "id").groupBy("band", "key").agg(F.max(F.struct("degree", (-F.col("id")).alias("low"))).alias("centre")).select("band", "key", (-F.col("centre.low")).alias("centre"))
    centres = materialize(centres, "near-centres")
    centred = materialize(members.select("id", "band", "key").join(centres, ["band", "key"]), "near-centred")
    discard(buckets, members, centres)
    members = centred
    sketch = reps.select("id", "n", "sketch")

    def with_sketches(pairs: DataFrame) -> DataFrame:
        a = sketch.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = sketch.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        return pairs.join(a, "a").join(b, "b")

    star = members.where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    links = _verified(_likely(with_sketches(star), percent), texts, shingle, percent, key)

    # what the stars left apart
    groups = connected_components(links, name="near-star-components")
    apart = members.join(groups, "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("component"))
    mixed = apart.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi and size > 2")
    mixed = materialize(mixed.select("band", "key"), "near-mixed")
    rest = materialize(apart.join(mixed, ["band", "key"]).join(sketch, "id"), "near-rest")
    discard(mixed, members, reps)
    paired = _blocks(rest).groupBy("bin").applyInPandas(lambda pdf: _with_likely_partner(pdf, percent), "band int, key long, id long")
    paired = materialize(paired.distinct(), "near-paired")
    blocks = rest
    items = _item_sets(paired.select("id").distinct(), texts, shingle, key)
    rest = paired.join(rest.select("band", "key", "id", "component"), ["band", "key", "id"]).join(items, "id")
    more = _blocks(rest).groupBy("bin").applyInPandas(lambda pdf: _forest(pdf, percent), "a long, b long")

    found = connected_components(links.unionByName(more).unionByName(same), name="near-components")
    discard(links, same, blocks, paired, items)
    out = sizes_of.where("id is not null").join(found, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    out = out.unionByName(sizes_of.where("id is null").withColumn("component", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def op8_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_shingles, component_id, kept; links on 2-word shingles at 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, percent=80)


#: All pairs by their definition, and the components of their links.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_zip(w[:-2], w[2:]) ELSE [struct_pack(a := w[1], b := NULL)] END) AS s FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
reached AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reached r JOIN l ON l.a = r.b),
least AS (SELECT a, least(a, min(b)) AS component FROM reached GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.a = w.doc_id
"""
