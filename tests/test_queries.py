"""Every registered alignment query against its SQL on the smallest tables, and sources and sinks."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cellweave.plans import queries as P
from cellweave.sources import io

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}" + ("/*.parquet" if os.path.isdir(f"{SF}/{f}") else "")
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{path}'")
    return con


def plain(rows, names):
    at = sorted(range(len(names)), key=names.__getitem__)
    show = lambda v: f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)
    return sorted(tuple(show(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", P.ORACLE_SQL)
def test_against_sql(spark, db, name):
    df = P.QUERIES[name](spark, SF)
    want = db.sql(P.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


def test_files(spark, tmp_path):
    (tmp_path / "gt.csv").write_text("t,10001,2,http://kb/Foo\nshort,1\nt,x,0,bad\n")
    assert [tuple(r) for r in io.read_gt(spark, str(tmp_path / "gt.csv")).collect()] == [("t", 10001, 2, "Foo")]
    (tmp_path / "kb.jsonl").write_text('{"id":"1","name":"a"}\n{"id":"2","name":"b","path":"x > y"}\n')
    kb = io.read_kb(spark, f"{tmp_path}/kb.jsonl,{tmp_path}/missing.jsonl")
    assert [(r.id, r.path) for r in kb.orderBy("pos").collect()] == [("1", ""), ("2", "x > y")]
    io.write_kb(kb, str(tmp_path / "out"))
    assert io.read_kb(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "pairs.tsv").write_text('a "q"\tb\t1\nx\ty\nc\td\tno\n')
    assert io.read_pairs(spark, str(tmp_path / "pairs.tsv"), strict=True).count() == 1
    (tmp_path / "wt.csv").write_text('c,a__b__3__1,0,"New York, city"\nc,bad,0,x\n')
    assert [tuple(r) for r in io.read_wt_gt(spark, str(tmp_path / "wt.csv")).collect()] == [("a__b", 3, 1, 0, "New York, city")]
    io.append_results(spark.range(1).selectExpr("0.12345 as accuracy"), "m", str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).first().accuracy in ("0.1234", "0.1235")


def test_every_vector_is_asked(spark, db):
    """knn_topk ranks ten rows for each vector."""
    asked = {r.qid: r["n"] for r in P.QUERIES["knn_topk"](spark, SF).groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert asked == {i: 10 for (i,) in db.sql("SELECT vec_id FROM embeddings").fetchall()}


def test_every_vector_is_evaluated(spark, db):
    """knn_label_eval counts each vector once."""
    assert P.QUERIES["knn_label_eval"](spark, SF).first().n == db.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]


def test_every_mention_is_asked(spark, db):
    """bm25_topk ranks ten parts for each part that lineitem names."""
    asked = {r.qid: r["n"] for r in P.QUERIES["bm25_topk"](spark, SF).groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert asked == {i: 10 for (i,) in db.sql("SELECT DISTINCT p_partkey FROM part JOIN lineitem ON l_partkey = p_partkey").fetchall()}


def test_every_mention_is_evaluated(spark, db):
    """bm25_eval counts each part that lineitem names."""
    assert P.QUERIES["bm25_eval"](spark, SF).first().n == db.sql("SELECT count(DISTINCT p_partkey) FROM part JOIN lineitem ON l_partkey = p_partkey").fetchall()[0][0]
