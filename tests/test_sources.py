"""Every source and sink on small files, order of several files, and operators that SQL doesn't cover."""

import gzip
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import text as X
from cellweave.functions import vectors as V
from cellweave.operators import evaluation as E
from cellweave.operators import matching as M
from cellweave.operators import ranking
from cellweave.operators import retrieval as R
from cellweave.operators import sampling as S
from cellweave.plans import queries as P
from cellweave.sources import io

SF = "/root/testdata/sf0.001"


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_kb_order_of_several_files(spark, tmp_path):
    """A short first file and a long second one: the list's order counts, not the size or the name."""
    z = lines(tmp_path / "z.jsonl", [{"id": f"z{i}", "name": "z"} for i in range(3)])
    a = lines(tmp_path / "a.jsonl", [{"id": f"a{i}", "name": "a" * 50} for i in range(5000)])
    kb = io.read_kb(spark, f"{z}, {tmp_path}/missing.jsonl, {a}")
    assert [r.id for r in kb.orderBy("pos").limit(5).collect()] == ["z0", "z1", "z2", "a0", "a1"]
    assert [r.id for r in io.read_kb(spark, f"{z},{a}", max_entities=4).orderBy("pos").collect()] == ["z0", "z1", "z2", "a0"]
    own = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert [r.id for r in io.read_kb(spark, [z, a]).orderBy("pos").collect()] == [f"z{i}" for i in range(3)] + [f"a{i}" for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", own)
    # rules of the first and the last row over both files
    lines(tmp_path / "one.jsonl", [{"id": "x", "name": "first"}, {"id": "y", "name": "y"}])
    lines(tmp_path / "two.jsonl", [{"id": "n", "name": "n"}] * 500 + [{"id": "x", "name": "last"}])
    both = io.read_kb(spark, f"{tmp_path}/one.jsonl,{tmp_path}/two.jsonl")
    pick = lambda df: {r.id: r.name for r in df.collect()}["x"]
    assert pick(M.dedupe(both, "id")) == "first" and pick(M.dedupe(both, "id", keep="last")) == "last"
    labels = spark.createDataFrame([("x",)], "id string")
    assert M.attach_names(labels, both, "id", "name").first()["name"] == "last"
    assert io.read_kb(spark, f"{tmp_path}/nothing.jsonl").count() == 0


def test_labels(spark, tmp_path):
    (tmp_path / "gt.csv").write_text('"t, with comma",7,1,"http://kb/a ""quoted"" one"\nt,8,2,x,extra\nt,9,3\nt,10,1,\n')
    got = sorted(map(tuple, io.read_gt(spark, str(tmp_path / "gt.csv")).collect()))
    assert got == [("t", 8, 2, "x"), ("t", 10, 1, ""), ("t, with comma", 7, 1, 'a "quoted" one')]
    (tmp_path / "head.csv").write_text("cell,text,id,gold_id\n , a ,k, \nb,,,g\n,,x,y\n")
    assert sorted(map(tuple, io.read_headed_gt(spark, str(tmp_path / "head.csv")).collect())) == [("a", "k"), ("b", "g")]
    assert [tuple(r) for r in io.read_table(spark, str(tmp_path / "head.csv"), header=False).limit(1).collect()] == [("cell", "text", "id", "gold_id")]


def test_chunks(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(f"p{i}", "b") for i in range(3)], "title string, brand string").coalesce(1).write.parquet(f"{root}/stage")
    next((tmp_path / "stage").glob("*.parquet")).rename(tmp_path / "wdc_part_1.parquet")
    (tmp_path / "wdc_part_1.csv").write_text("title,brand\nwrong,b\n")
    (tmp_path / "wdc_part_2.csv").write_text("title,brand\n" + "".join(f"c{i},b\n" for i in range(4)))
    for f in (tmp_path / "stage").iterdir():
        f.unlink()
    got = {r.abs_row: (r.title, r.chunk_idx, r.row_in_chunk) for r in io.read_chunks(spark, root).collect()}
    assert got == {10_000 + i: (f"p{i}", 1, i) for i in range(3)} | {20_000 + i: (f"c{i}", 2, i) for i in range(4)}
    with pytest.raises(ValueError):
        io.read_chunks(spark, str(tmp_path / "none"))
    rows = spark.range(25_000).select(F.col("id").alias("abs_row"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title")).repartition(3)
    io.split_rows(rows, f"{root}/split")
    back = io.read_chunks(spark, f"{root}/split")
    assert back.where(F.col("title") != F.concat(F.lit("t"), F.col("abs_row").cast("string"))).count() == 0 and back.count() == 25_000
    assert sorted(r.n for r in back.groupBy("chunk_idx").agg(F.count("*").alias("n")).collect()) == [5000, 10_000, 10_000]


def test_converted_chunks(spark, tmp_path):
    source, target = tmp_path / "csv", str(tmp_path / "parquet")
    source.mkdir()
    for i in range(3):
        (source / f"part_{i}.csv").write_text(f'title,brand\n"t{i}, quoted",b\n')
    (source / "other.csv").write_text("title\nx\n")
    (source / "short.csv").write_text("title,brand\na,b\nonly one\n")
    (source / "long.csv").write_text("title,brand\na,b,c\n")
    (source / "binary.csv").write_bytes(bytes(range(128, 256)) * 40)
    (source / "nothing.csv").write_text("")
    (source / "twice.csv").write_text("title,Title\na,b\n")
    (source / "header only.csv").write_text("title,brand\n")
    good, bad = ["header only.csv", "other.csv", "part_0.csv", "part_1.csv", "part_2.csv"], ["binary.csv", "long.csv", "nothing.csv", "short.csv", "twice.csv"]
    assert io.convert_chunks(spark, str(source), target) == (good, bad)
    assert sorted(r.title for r in spark.read.parquet(target).collect()) == ["t0, quoted", "t1, quoted", "t2, quoted", "x"]
    (source / "part_9.csv").write_text("title,brand\nt9,b\n")
    assert io.convert_chunks(spark, str(source), target) == (["header only.csv", "part_9.csv"], bad)
    assert sorted(r.title for r in spark.read.parquet(target).where("file like 'part%'").collect()) == ["t0, quoted", "t1, quoted", "t2, quoted", "t9"]
    assert io.convert_chunks(spark, str(tmp_path / "none"), target) == ([], [])


def test_wikitables(spark, tmp_path):
    table = {"_id": "t1", "pgId": 3, "tableData": [[{"text": " a ", "surfaceLinks": [{"target": {"title": ""}}, {"target": {"title": "New_York"}}]}, {"text": "", "surfaceLinks": []}]]}
    with gzip.open(tmp_path / "tables.jsonl.gz", "wt") as f:
        f.write(json.dumps(table) + "\n\nnot json\n")
    df = io.read_wikitables(spark, str(tmp_path / "tables.jsonl.gz"), parts=2)
    assert df.count() == 1
    from cellweave.plans import wikitables as W

    cells = W.linked_cells(W.table_rows(df)).collect()
    assert [(r.table_id, r.row, r.col, r.text, r.title, r.row_text) for r in cells] == [("t1", 0, 0, "a", "New_York", "a")]
    labels = spark.createDataFrame([("t1", 0, 0), ("t1", 4, 0), ("t9", 0, 0)], "table_id string, row int, col int")
    assert sorted((r.row, r.text, r.row_context) for r in M.extract_cells(df, labels, row_context=True).collect()) == [(0, "a", "a | "), (4, "", "")]
    (tmp_path / "gt.csv").write_text('wiki,t1__0__0,0,"New York"\n')
    kind, gt = io.open_dataset(spark, str(tmp_path))
    assert kind == "wikitables" and gt.count() == 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "gt.csv").write_text("t,1,2,x\n")
    assert io.open_dataset(spark, str(tmp_path / "d"))[0] == "chunks"
    with pytest.raises(ValueError):
        io.open_dataset(spark, str(tmp_path / "empty"))


def test_pairs_and_entities(spark, tmp_path):
    (tmp_path / "pairs.tsv").write_text("a\tb\t1\nx\ty\nc\td\tno\n")
    assert sorted(map(tuple, io.read_pairs(spark, str(tmp_path / "pairs.tsv")).collect())) == [("a", "b", 1), ("c", "d", 0)]
    df = spark.createDataFrame([("1", " n "), (" ", "x"), ("2", None)], "k string, v string")
    assert [tuple(r) for r in io.kb_from_table(df, "k", "v", "kind", "p:").collect()] == [("p:1", "n", "kind")]
    with pytest.raises(ValueError):
        io.kb_from_table(df, "k", "missing")
    assert M.drop_blank(df, "k", "v").count() == 1


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    index = spark.createDataFrame([("a", "A", "p", [3.0, 4.0], 1), ("b", "B", "q", [0.0, 2.0], 2)], "id string, name string, path string, vector array<double>, other int")
    io.save_index(index, f"{root}/index")
    back = io.load_index(spark, f"{root}/index", count=2)
    assert back.columns == ["id", "name", "path", "vector"] and {r.id: r.vector for r in back.collect()} == {"a": [0.6, 0.8], "b": [0.0, 1.0]}
    with pytest.raises(ValueError):
        io.load_index(spark, f"{root}/index", count=3)
    io.save_index(index.where("id = 'a'"), f"{root}/index")
    assert io.load_index(spark, f"{root}/index").count() == 1
    queries = spark.createDataFrame([(1,), (2,)], "qid long")
    cands = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "qid long, rank int, id string")
    io.save_candidates(cands, queries, f"{root}/cands")
    assert spark.read.parquet(f"{root}/cands").count() == 2
    with pytest.raises(ValueError):
        io.save_candidates(cands.unionByName(spark.createDataFrame([(3, 1, "c")], cands.schema)), queries, f"{root}/bad")
    io.save_candidates(cands.where("qid = 1"), queries, f"{root}/cands")
    back, asked = io.read_candidates(spark, f"{root}/cands")
    assert [tuple(r) for r in back.collect()] == [(1, 1, "a")] and sorted(r.qid for r in asked.collect()) == [1, 2]
    io.write_eval_split(cands, cands, queries.agg(F.count("*").alias("n")), f"{root}/split")
    assert spark.read.csv(f"{root}/split/gt.csv").count() == 2 and spark.read.json(f"{root}/split/prep_stats.json").first().n == 2
    for value in (0.12344, 0.98766):
        io.append_results(spark.createDataFrame([(value,)], "accuracy double"), "m", f"{root}/results")
    assert sorted(r.accuracy for r in spark.read.parquet(f"{root}/results").collect()) == ["0.1234", "0.9877"]
    io.write_dump(cands, f"{root}/dump")
    assert spark.read.json(f"{root}/dump").count() == 2
    assert io.write_normalized(cands, f"{root}/table.csv") == f"{root}/table.normalized.csv"
    assert spark.read.option("header", True).csv(f"{root}/table.normalized.csv").columns == ["qid", "rank", "id"]
    assert io.write_normalized(cands, f"{root}/plain") == f"{root}/plain.normalized"


# operators that SQL doesn't cover


def test_header_of_several(spark):
    cells = spark.createDataFrame([("t", -1, 0, "zeta", 0), ("t", -1, 0, "alpha", 1), ("t", 0, 0, "v", 2), ("u", 0, 0, "w", 3)], "table_id string, row int, col int, text string, pos int")
    assert sorted(r.text for r in M.prefix_header(cells).where("row >= 0").collect()) == ["w", "zeta : v"]


def test_running(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    rows = [(None if k == 3 else f"k{k}", float(v), int(w)) for k, v, w in zip(rng.integers(0, 4, 2000), rng.permutation(2000), rng.integers(1, 5, 2000))]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    got = {r.v: (r._upto, r._total) for r in ranking.running(df, ["v"], ["k"], "w").collect()}
    for k, v, _ in rows:
        own = [(x, w) for q, x, w in rows if q == k]
        assert got[v] == (sum(w for x, w in own if x <= v), sum(w for _, w in own))
    words = spark.createDataFrame([(w,) for w in ("b", "a", "Z", "é", "", "aa")], "v string")
    assert [r.v for r in ranking.running(words, ["v"]).orderBy("_upto").collect()] == sorted(["b", "a", "Z", "é", "", "aa"])
    assert ranking.running(df.limit(0), ["v"], ["k"]).count() == 0
    # skewed values still spread over the ranges
    sizes = [r["count"] for r in df.withColumn("r", ranking.range_number(df, "v", 16)).groupBy("r").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 700


def test_quantiles_with_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None), (None, 5.0), ("b", None)], "k string, v double")
    got = {r.k: r for r in E.quantile_stats(df, "v", "k").collect()}
    assert (got["a"].n, got["a"].p50, got["a"].p1) == (3, 2.0, 1.02) and got[None].p50 == 5.0 and got["b"].n == 0 and got["b"].p50 is None


def test_random_negatives(spark):
    """Each positive gets n others whatever the sizes, or all others if there are fewer."""
    for size in (2, 5, 40, 1000):
        positives = spark.createDataFrame([(i, i % size) for i in range(60)], "pid long, id long")
        got = S.random_negatives(positives, spark.range(size), 8, 1).collect()
        per = {}
        for r in got:
            per.setdefault(r.pid, []).append(r.id)
        assert len(per) == 60 and all(len(set(v)) == len(v) == min(8, size - 1) and p % size not in v for p, v in per.items())
    pairs = S.build_pairs(spark.createDataFrame([(1, 7)], "pid long, id long"), spark.range(50), 3, 1).collect()
    assert sorted(r.label for r in pairs) == [0, 0, 0, 1]


def test_column_neighbours(spark):
    cells = spark.createDataFrame([("t", -1, 0, "h"), ("t", 0, 0, "a"), ("t", 1, 0, "b"), ("t", -1, 1, "g")], "table_id string, row int, col int, text string")
    got = sorted((r.row, r.col, r.n_row, r.n_text) for r in M.column_neighbours(cells.where("text in ('a', 'g')"), M.column_store(cells)).collect())
    assert got == [(-1, 1, -1, "g"), (0, 0, 0, "a"), (0, 0, 1, "b")]


def test_encoder(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()}
    df = spark.createDataFrame([*docs.items(), (-1, None), (-2, docs[min(docs)])], "doc_id long, text string")
    got = {r.doc_id: r.vector for r in R.embed(df, "text").collect()}
    assert got[-1] is None and got[-2] == got[min(docs)]
    for i, t in docs.items():
        raw = f" {(t or '').lower()} ".encode()
        want = np.zeros(256)
        for j in range(len(raw) - 2):
            want[zlib.crc32(raw[j : j + 3]) % 256] += 1
        if t is not None:
            assert np.allclose(got[i], want / max(np.linalg.norm(want), 1e-12), atol=1e-6)
    assert P.QUERIES["embed_hash"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_exact_and_approximate_search(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    centres = rng.standard_normal((30, 32))
    x = np.vstack([c + 0.4 * rng.standard_normal((20, 32)) for c in centres])
    kb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    queries = kb.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    y = np.array([r.vector for r in kb.orderBy("id").collect()])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    exact = {}
    for r in R.knn_topk(queries, kb, 10).collect():
        exact.setdefault(r.qid, {})[r.rank] = r.id
    for q, found in exact.items():
        s = np.round(y @ y[q], 9)
        assert [found[k] for k in range(1, 11)] == np.lexsort((np.arange(len(s)), -s))[:10].tolist()
    near = {(r.qid, r.id) for r in R.knn_topk_lsh(queries, kb, 10).collect()}
    assert sum((q, i) in near for q, f in exact.items() for i in f.values()) / (10 * len(exact)) > 0.9
    longer = {(r.qid, r.id) for r in R.knn_topk_lsh(queries, kb, 10, bits=9).collect()}
    assert sum((q, i) in longer for q, f in exact.items() for i in f.values()) / (10 * len(exact)) > 0.9
    assert P.QUERIES["knn_lsh_recall"](spark, SF).first().recall >= 0.9
    assert R.knn_topk(queries, kb.limit(0), 3).count() == 0 and R.knn_topk(queries, kb.limit(2), 3).count() == 60


def test_bm25_of_few(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple apple"), (3, ""), (4, None)], "id long, name string")
    queries = spark.createDataFrame([(7, "Apple apple"), (8, "none of them"), (9, "red green")], "qid long, text string")
    got = [(r.qid, r.rank, r.id) for r in R.bm25_topk(docs, queries, 5).orderBy("qid", "rank").collect()]
    assert [g for g in got if g[0] == 7] == [(7, 1, 2), (7, 2, 1)] and not [g for g in got if g[0] == 8] and {g[2] for g in got if g[0] == 9} == {1, 2}
    assert R.bm25_topk(docs.limit(0), queries, 5).count() == 0 and R.bm25_topk(docs, queries.limit(0), 5).count() == 0


def test_more_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(X.truncate(F.lit(t).cast("string"), 5)) for t in (None, "abcde", "abcdef")] == ["---", "abcde", "abc.."]
    assert one(V.sigmoid(F.lit(0.0))) == 0.5
    assert one(X.with_context(F.lit(" "), F.lit(""))) == " " and one(X.with_context(F.lit("a"), F.lit("b"))) == "a [SEP] b"
    assert one(X.ser_bracket_entity(F.lit("x y"))) == "[COL] name [VAL] x y" and one(X.ser_ditto_entity(F.lit(None).cast("string"))) == "COL name VAL"
    big = spark.createDataFrame([(1, 1, "a", 900.0), (1, 2, "b", 899.0)], "qid long, rank int, id string, score double")
    kb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    assert sum(R.context_vector(big, kb).first().vector) == pytest.approx(1)


def test_name_cases(spark):
    dump = lambda rows: spark.createDataFrame(rows, "k long, pos int, gold_name string, top1_name string")
    a = dump([(1, 0, "Foo", "bar"), (1, 1, "Foo", "foo"), (2, 0, "", "x"), (3, 0, "B c", "b-c"), (4, 0, "d", "d")])
    b = dump([(1, 0, "Foo", "no"), (2, 0, "z", "z"), (3, 0, "other", "B C"), (5, 0, "e", "e")])
    got = {r.k: (r.bucket, r.ok_0, r.ok_1) for r in E.name_cases(a, b, key=["k"]).collect()}
    assert got == {1: ("only_a", True, False), 3: ("all_correct", True, True)}
