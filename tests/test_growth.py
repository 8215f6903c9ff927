"""What searches copy between tasks grows no faster than their input."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cellweave.operators import index, retrieval
from cellweave.plans.queries import QUERIES

SEARCHES = ["candidate_pool", "candidate_hits", "context_vectors", "knn_label_eval", "knn_topk", "diagnosis", "hard_negatives"]


def shuffled(spark, run):
    """Bytes that stages which run() starts write for others."""
    sc = spark.sparkContext
    jvm, store, bus = sc._jvm, sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty(30_000)
        rows = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return [rows.apply(i) for i in range(rows.size())]

    last = max((s.stageId() for s in stages()), default=-1)
    run()
    return sum(s.shuffleWriteBytes() for s in stages() if s.stageId() > last)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """2000 and 8000 evenly spread vectors, of which bounds leave out next to nothing."""
    rng, out = np.random.default_rng(9), []
    for n in (2000, 8000):
        d = tmp_path_factory.mktemp(f"vectors{n}")
        x = rng.standard_normal((n, 32)).astype(np.float32)
        pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": pa.array([i % 10 for i in range(n)], pa.int32())}), d / "embeddings.parquet")
        out.append(str(d))
    return out


@pytest.mark.parametrize("name", SEARCHES)
def test_shuffle_grows_with_the_input(spark, tables, monkeypatch, name):
    """Four times the vectors have four times the pivots and queries; a kb that is copied for each of their blocks is sixteen times as much."""
    monkeypatch.setattr(retrieval, "PIVOT_ROWS", 100)
    monkeypatch.setattr(retrieval, "LEAST_BLOCK", 8)
    small, large = (shuffled(spark, lambda: QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()) for d in tables)
    assert large < 5.5 * small


def test_copies_for_many_queries(spark):
    """200,000 short vectors as queries are few numbers, so the kb is copied no oftener than it takes to keep the cores busy."""
    q = spark.range(200_000).selectExpr("id AS qid", "array(sin(id), cos(id)) AS vector")
    kb = spark.range(50).selectExpr("id", "array(cos(id), sin(id)) AS vector")
    search = retrieval.CosineSearch(q, kb, 5)
    assert search.pairs().select("x_bundle").distinct().count() <= 3 * spark.sparkContext.defaultParallelism
    # what a bundle of queries leaves is bounded, too
    wide = retrieval.CosineSearch(q, kb, 500)
    assert wide.pairs().select("x_bundle").distinct().count() >= 200_000 * 500 / retrieval.NUMBERS_BLOCK - 1


def test_what_leaves_an_index_grows_with_the_input(spark, tables, tmp_path, monkeypatch):
    """Four times the vectors have four times the queries and a short list four times as long: only the k best of a bundle may leave it."""
    monkeypatch.setattr(index, "LEAST_BLOCK", 8, raising=False)
    sizes = []
    for d in tables:
        v = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
        quantiser = index.train(v)
        path = f"{tmp_path}/{len(sizes)}"
        index.write(index.encode(v, quantiser), path)
        rows, n = index.read(spark, path), len(quantiser.centres)
        near = index.search(v.where("id % 20 = 0").withColumnRenamed("id", "qid"), rows, quantiser, 10, 3 * n // 4, rows.count() // 10)
        sizes.append(shuffled(spark, lambda: near.write.format("noop").mode("overwrite").save()))
    assert sizes[1] < 5.5 * sizes[0]
    assert sum(1 for _ in Path(path).rglob("*.parquet")) <= 2 * n


def test_a_small_index_bundle_finds_what_a_large_one_does(spark, tables, monkeypatch):
    """Rows dealt to several bundles: with all lists and a short list of all rows the search is exact."""
    v = spark.read.parquet(f"{tables[0]}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    q = v.where("id % 100 = 0").withColumnRenamed("id", "qid")
    quantiser = index.train(v)
    rows = index.encode(v, quantiser).cache()
    monkeypatch.setattr(index, "BUNDLE_ROWS", 300)
    exact = [tuple(r) for r in retrieval.knn_topk(q, v, 10).orderBy("qid", "rank").collect()]
    lists = len(quantiser.centres)
    assert [tuple(r) for r in index.search(q, rows, quantiser, 10, lists, 7 * 2000).orderBy("qid", "rank").collect()] == exact
    probes, shortlist = index.tune(rows, quantiser, 10, 1000)
    near = {(r.qid, r.id) for r in index.search(q, rows, quantiser, 10, probes, shortlist).collect()}
    assert 70 <= shortlist <= 1000 and len(near & {(r[0], r[2]) for r in exact}) >= 0.9 * len(exact)
