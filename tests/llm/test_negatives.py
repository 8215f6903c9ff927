"""Hard negatives against all pairs in Python, and the registered query against its SQL."""

import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import negatives, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, step, scale=256.0, window=(50, 95)):
    """rows (vec_id, label, vector); scores in Python's integers."""
    good = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(scale * x) for x in v]
        if math.sqrt(sum(float(x) * x for x in w)) < 2.0**31:
            good.append((i, label, w))
    out = []
    for i, label, v in good:
        if i % step:
            continue
        near = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good if j != i and len(w) == len(v)]
        near.sort(key=lambda t: t[:2])
        for p, j, _ in [t for t in near if t[2] == label][:5]:
            p = -p
            fit = [(-s, k) for s, k, m in near if m != label and window[0] * p <= -100 * s <= window[1] * p][:3]
            out += [(i, j, r + 1, k, p, s) for r, (s, k) in enumerate(fit)]
    return sorted(out)


def crowd(seed, n, dim, labels=4, spread=0.6):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((labels, dim))
    own = rng.integers(0, labels, n)
    x = middles[own] * 0.5 + spread * rng.standard_normal((n, dim))
    return [(int(i), int(own[i] if rng.random() < 0.7 else rng.integers(0, labels)), [float(np.float32(c)) for c in x[i]]) for i in range(n)]


def mined(spark, rows, step, schema=SCHEMA, **how):
    return sorted(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % step == 0, **how).collect())


def test_against_all_pairs(spark, monkeypatch):
    rows = crowd(1, 1500, 12)
    want = plain(rows, 10)
    assert len(want) > 1000
    assert mined(spark, rows, 10, scale=256.0) == want
    monkeypatch.setattr(negatives, "BLOCK_NUMBERS", 600)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    monkeypatch.setattr(negatives, "HEAD", 40)
    assert mined(spark, rows, 10, scale=256.0) == want


def test_ties_and_repeats(spark):
    rows = [(i, i % 3, [1.0, float(i % 2), -1.0]) for i in range(60)] + [(7, 1, [1.0, 1.0, -1.0]), (10, 2, [3.0, 1.0, 0.0]), (10, 2, [3.0, 1.0, 0.0])]
    assert mined(spark, rows, 10, scale=2.0) == plain(rows, 10, 2.0)


def test_edges(spark):
    rows = crowd(2, 80, 4) + [
        (None, 1, [1.0] * 4), (100, None, [1.0] * 4), (101, 1, None), (102, 1, []), (103, 1, [1.0, None, 0.0, 0.0]), (104, 1, [float("nan")] * 4), (105, 1, [float("inf")] * 4),
        (110, 2, [0.0] * 4), (120, 3, [1e30] * 4), (130, 1, [100.0] * 4), (131, 1, [100.0, 3.0]), (140, 1, [2.0, 3.0]), (150, 2, [1.0, 3.0]), (160, 9, [1.0, 1.0, 1.0, 1.0]),
        (170, 1, [200000.0, 1.0, -70000.0, 3.0]), (171, 1, [210000.0, 1.0, -70000.0, 3.0]), (172, 2, [150000.0, 1.0, -70000.0, 3.0]),
    ]
    got = mined(spark, rows, 10, scale=256.0)
    assert got == plain(rows, 10)
    assert any(r[0] == 170 for r in got)
    clashing = spark.createDataFrame(rows, SCHEMA).withColumns({"Row": F.lit("x"), "cell": F.lit(None).cast("string"), "anchors": F.lit(1)})
    assert sorted(tuple(r) for r in negatives.mine(clashing, F.col("vec_id") % 10 == 0, scale=256.0).collect()) == got
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])], 10) == []
    assert mined(spark, [(10, 1, [1.0])], 10) == []
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([("a", 1, [1.0])], "vec_id string, label int, embedding array<double>"), F.lit(True))


def test_exact_beyond_double_precision(spark):
    big = 2.0**29
    rows = [(0, 0, [big, big - 1.0, 1.0]), (1, 0, [big, big - 3.0, 1.0]), (2, 1, [big / 2 + 1, big / 2, 3.0]), (3, 1, [big / 2 + 1, big / 2, 4.0]), (4, 1, [big - 1.0, big / 4, 0.0])]
    assert mined(spark, rows, 10, "vec_id long, label int, embedding array<double>") == plain(rows, 10, 1.0)


def test_walk_stops_early(spark):
    """Where anchors have near candidates, the walk ends long before the end of the list."""
    rng = np.random.default_rng(4)
    middles = rng.standard_normal((40, 32))
    own = rng.integers(0, 40, 20_000)
    x = middles[own] + 0.15 * rng.standard_normal((20_000, 32))
    rows = [(i, int(own[i]) % 10 if rng.random() < 0.9 else 10, x[i].tolist()) for i in range(20_000)]
    found = negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 20 == 0, scale=256.0)
    assert found.count() > 0
    work = [w.agg(F.sum("work")).first()[0] for w in found._work]
    assert max(work) < 0.3 * 1000 * 20_000


def test_registered_query_against_sql(spark):
    want = duckdb.sql(queries.ORACLE_SQL["op12_hard_negatives"].replace("embeddings", f"'{SF}/embeddings.parquet'"))
    got = queries.QUERIES["op12_hard_negatives"](spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert set(want.columns) == set(got.columns)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(tuple(r[want.columns.index(c)] for c in got.columns) for r in want.fetchall())
    per = defaultdict(list)
    for r in rows:
        per[r[:2]].append(r[2])
    assert all(ranks == list(range(1, len(ranks) + 1)) for ranks in per.values())
