"""Registered queries that write a given table with a sink, read it back with a source, and return what they find."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import retrieval as R
from ..sources import io
from .queries import _part_kb, _query, _t, _vectors


@_query("SELECT cast(p_partkey AS varchar) AS id, concat_ws(' ', p_name, replace(p_brand, '#', ''), p_type, cast(p_size AS varchar)) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE '' END AS path FROM part")
def kb_files(spark, d):
    """Parts as two JSON-lines knowledge bases, read as a list that also names a missing one."""
    kb = _part_kb(spark, d).withColumn("path", F.when(F.col("id") % 2 == 0, "even"))
    root = io.scratch(spark, "kb")
    for k in (0, 1):
        io.write_kb(kb.where(F.col("id") % 2 == k).withColumn("id", F.col("id").cast("string")), f"{root}/{k}")
    return io.read_kb(spark, f"{root}/1, {root}/missing, {root}/0").select("id", "name", "path")


@_query("SELECT cast(p_partkey AS varchar) AS id, p_name AS name FROM part WHERE p_partkey < (SELECT count(*) // 3 FROM part)")
def kb_head(spark, d):
    """The first third of a knowledge base in the order of its files."""
    kb = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), "p_partkey")
    path = io.scratch(spark, "kb")
    io.write_kb(kb.repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey"), path)
    return io.read_kb(spark, path, max_entities=kb.count() // 3).select("id", "name")


@_query("""SELECT 't, ' || l_orderkey AS table_id, l_partkey AS abs_row, l_linenumber AS col, 'the "' || l_returnflag || '" one' AS entity_id FROM lineitem WHERE l_linenumber <> 3""")
def label_files(spark, d):
    """S3, F1: labels of lines as a CSV without a header; quoted fields, ids with a prefix, short rows."""
    li = _t(spark, d, "lineitem")
    path = io.scratch(spark, "gt")
    entity = F.concat(F.lit('http://kb/the "'), "l_returnflag", F.lit('" one'))
    li.where("l_linenumber <> 3").select(F.concat(F.lit("t, "), "l_orderkey"), "l_partkey", "l_linenumber", entity).write.option("escape", '"').csv(path)
    li.where("l_linenumber = 3").select(F.concat_ws(",", F.lit("t"), "l_partkey", "l_linenumber")).write.mode("append").text(path)
    return io.read_gt(spark, path)


@_query("SELECT CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'cell ' || c_custkey END AS text, cast(c_nationkey AS varchar) AS gold FROM customer WHERE c_custkey % 5 <> 0")
def headed_labels(spark, d):
    """Labels in a CSV with a header, the text in one of two columns, some without a gold."""
    c = _t(spark, d, "customer")
    path = io.scratch(spark, "headed")
    even = F.col("c_custkey") % 2 == 0
    c.select(F.when(even, F.col("c_name")).alias("cell_text"), F.concat(F.lit("cell "), "c_custkey").alias("cell"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("gold_id")).write.option("header", True).csv(path)
    return io.read_headed_gt(spark, path)


@_query("SELECT 'conv__' || conv_id AS table_id, cast(turn AS int) AS row, cast(conv_id % 3 AS int) AS col, cast(0 AS int) AS zero, role AS title FROM conversations")
def cell_key_labels(spark, d):
    """Labels of turns with keys of three parts, of which the first holds the separator, too."""
    c = _t(spark, d, "conversations")
    path = io.scratch(spark, "wt")
    key = F.concat(F.lit("conv__"), "conv_id", F.lit("__"), "turn", F.lit("__"), (F.col("conv_id") % 3).cast("string"))
    c.select(F.lit("wiki"), key, F.lit(0), "role").write.option("quoteAll", True).csv(path)
    c.select(F.lit("wiki"), F.lit("no key"), F.lit(0), "role").write.mode("append").option("quoteAll", True).csv(path)
    return io.read_wt_gt(spark, path)


@_query("SELECT p_partkey AS abs_row, cast(p_partkey // 10000 AS int) AS chunk_idx, cast(p_partkey % 10000 AS int) AS row_in_chunk, p_name AS title FROM part")
def chunk_files(spark, d):
    """Parts in chunks of 10,000 rows; their places come back from chunk and row."""
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("abs_row"), F.col("p_name").alias("title"))
    path = io.scratch(spark, "chunks")
    io.split_rows(rows, path)
    return io.read_chunks(spark, path).select("abs_row", "chunk_idx", "row_in_chunk", "title")


@_query("SELECT cast(conv_id AS varchar) AS table_id, count(*) AS rows, cast(sum(length(text)) AS bigint) AS chars FROM conversations GROUP BY conv_id")
def nested_files(spark, d):
    """Conversations as zipped JSON lines of nested tables, between blank and broken lines."""
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.array(F.struct(F.col("text").alias("text"), F.array().cast("array<struct<target:struct<title:string>>>").alias("surfaceLinks"))).alias("cells"))
    tables = rows.groupBy(F.col("conv_id").cast("string").alias("_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "cells"))), lambda r: r["cells"]).alias("tableData"))
    root = io.scratch(spark, "nested")
    path = f"{root}/tables.jsonl"
    tables.write.option("compression", "gzip").json(path)
    spark.range(3).select(F.when(F.col("id") == 0, "").otherwise("{broken")).write.mode("append").option("compression", "gzip").text(path)
    rows.select(F.lit("wiki"), F.concat(F.col("conv_id"), F.lit("__0__0")), F.lit(0), F.lit("x")).write.csv(f"{root}/gt.csv")
    if io.open_dataset(spark, root)[0] != "wikitables":
        raise ValueError("not told from table chunks")
    cells = io.read_wikitables(spark, path, parts=4).select(F.col("_id").alias("table_id"), F.flatten("tableData").alias("c"))
    length = F.aggregate("c", F.lit(0).cast("long"), lambda s, c: s + F.length(c["text"]))
    return cells.select("table_id", F.size("c").cast("long").alias("rows"), length.alias("chars"))


@_query("SELECT 'order ' || l_orderkey AS left, 'part ' || l_partkey AS right, cast(l_linenumber % 2 AS int) AS label FROM lineitem WHERE l_linenumber < 5")
def pair_files(spark, d):
    """Tab-separated pairs; short lines and, as labels are asked for, those without a whole label are dropped."""
    li = _t(spark, d, "lineitem")
    label = F.when(F.col("l_linenumber") < 5, (F.col("l_linenumber") % 2).cast("string")).when(F.col("l_linenumber") == 5, "no")
    path = io.scratch(spark, "pairs")
    li.select(F.concat_ws("\t", F.concat(F.lit("order "), "l_orderkey"), F.concat(F.lit("part "), "l_partkey"), label)).write.text(path)
    return io.read_pairs(spark, path, strict=True)


@_query("SELECT cast(n_nationkey AS varchar) AS n_nationkey, n_name, cast(n_regionkey AS varchar) AS n_regionkey FROM nation")
def normalized_files(spark, d):
    """A table written beside its source and read as any CSV."""
    path = io.write_normalized(_t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{io.scratch(spark, 'table')}/nation.csv")
    return io.read_table(spark, path)


@_query("SELECT vec_id AS id, cast(1 AS double) AS norm, 'v' || vec_id AS name FROM embeddings")
def index_files(spark, d):
    """Vectors as a stored index with names; they come back with length 1, as many as were written."""
    v = _vectors(spark, d)[1].select("id", "vector", F.concat(F.lit("v"), "id").alias("name"))
    path = io.scratch(spark, "index")
    io.save_index(v, path)
    back = io.load_index(spark, path, count=v.count())
    return back.select("id", F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), "name")


@_query("""WITH c AS (SELECT l_orderkey AS qid, count(*) AS n FROM lineitem WHERE l_orderkey % 4 > 0 GROUP BY 1)
SELECT o_orderkey AS qid, coalesce(n, 0) AS n FROM orders LEFT JOIN c ON qid = o_orderkey""")
def candidate_files(spark, d):
    """The lines of orders as candidates; orders without one are stored, too."""
    cands = _t(spark, d, "lineitem").where("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("id"))
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("qid"))
    path = io.scratch(spark, "candidates")
    io.save_candidates(cands.join(orders, "qid", "left_semi"), orders, path)
    back, asked = io.read_candidates(spark, path)
    return asked.join(back.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))


@_query("SELECT conv_id || '__' || turn || '__0' AS cell_key, role AS title, trim(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g')) AS text, (SELECT count(*) FROM conversations) AS cells FROM conversations")
def split_files(spark, d):
    """Labels, cells and counts of an evaluation split."""
    c = _t(spark, d, "conversations").withColumn("key", F.concat_ws("__", "conv_id", "turn", F.lit("0"))).withColumn("text", F.trim(F.regexp_replace("text", r"[\t\r\n]", " ")))
    path = io.scratch(spark, "split")
    io.write_eval_split(c.select(F.lit("conv"), "key", F.lit(0), "role"), c.select("key", "text"), c.agg(F.count("*").alias("cells")), path)
    gt = spark.read.csv(f"{path}/gt.csv").toDF("corpus", "cell_key", "zero", "title")
    cells = spark.read.csv(f"{path}/cells.tsv", sep="\t").toDF("cell_key", "text")
    return gt.join(cells, "cell_key").crossJoin(spark.read.json(f"{path}/prep_stats.json")).select("cell_key", "title", F.coalesce("text", F.lit("")).alias("text"), "cells")


@_query("SELECT l_returnflag AS method, printf('%.4f', avg(cast(l_discount AS double))) AS accuracy, printf('%.4f', avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END)) AS hit FROM lineitem GROUP BY l_returnflag")
def results_files(spark, d):
    """One row of measures for each flag, added to a table of results one after the other."""
    li = _t(spark, d, "lineitem")
    path = io.scratch(spark, "results")
    for (flag,) in li.select("l_returnflag").distinct().orderBy("l_returnflag").collect():  # three flags
        io.append_results(li.where(F.col("l_returnflag") == flag).agg(F.avg(F.col("l_discount").cast("double")).alias("accuracy"), F.avg(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)).alias("hit")), flag, path)
    return spark.read.parquet(path)


@_query("SELECT cast(s_suppkey AS varchar) AS title, s_name AS brand FROM supplier")
def converted_files(spark, d):
    """CSV chunks as Parquet, those of a second call only."""
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("title"), F.col("s_name").alias("brand"))
    root = io.scratch(spark, "convert")
    for k in (0, 1):
        s.where(F.col("title") % 2 == k).write.mode("append").option("header", True).csv(f"{root}/csv")
        done, failed = io.convert_chunks(spark, f"{root}/csv", f"{root}/parquet")
        if failed:
            raise ValueError(f"not read: {failed}")
    return spark.read.parquet(f"{root}/parquet").select(F.col("title").cast("string").alias("title"), "brand")


@_query("SELECT o_orderkey AS table_idx, o_orderstatus AS gold_id, o_custkey || ',' || (o_custkey + 1) AS top, round(cast(o_totalprice AS double), 2) AS score FROM orders")
def dump_files(spark, d):
    """A dump with an array in each row, one JSON object a line."""
    o = _t(spark, d, "orders")
    path = io.scratch(spark, "dump")
    io.write_dump(o.select(F.col("o_orderkey").alias("table_idx"), F.col("o_orderstatus").alias("gold_id"), F.array("o_custkey", F.col("o_custkey") + 1).alias("top"), F.round(F.col("o_totalprice").cast("double"), 2).alias("score")), path)
    back = spark.read.schema("table_idx long, gold_id string, top array<string>, score double").json(path)
    return back.withColumn("top", F.array_join("top", ","))


@_query("SELECT 10 * count(*) FILTER (vec_id % 20 = 0) AS n, true AS recall_reached, true AS work_kept FROM embeddings")
def index_search(spark, d):
    """The ten nearest by a stored index of lists and codes; whether it finds 0.9 of them and scores a tenth of all pairs or less."""
    q, v = _vectors(spark, d)
    quantiser = I.train(v)
    rows = I.encode(v, quantiser)
    path = io.scratch(spark, "lists")
    I.write(rows.where("id % 3 > 0"), path)
    I.append(rows.where("id % 3 = 0"), path)
    total, asked = v.count(), q.count()
    stored = I.read(spark, path, total)
    probes, shortlist = I.tune(stored, quantiser, 10, total // 10)
    near = I.search(q, stored, quantiser, 10, probes, shortlist)
    exact = R.knn_topk(q, v, 10).select("qid", "id")
    hits = exact.join(near.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hits.agg(F.count("*").alias("n"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"), F.lit(10 * shortlist * asked <= total * asked).alias("work_kept"))
