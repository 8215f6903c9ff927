"""Registered queries of candidate pools, pairs by text, cells of nested tables, training sets and diagnoses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import evaluation as E
from ..operators import matching as M
from ..operators import retrieval as R
from ..operators import sampling as S
from ..sources import io
from . import wikitables
from .queries import bm25_sql, _KNN_SQL, _linked_turns, _part_kb, _query, _t, _vectors


def _named(v):
    return v.withColumn("name", F.concat(F.lit("v"), F.col("id").cast("string")))


@_query(_KNN_SQL + "SELECT qid, rank, id, 'v' || id AS name, round(score, 6) AS score FROM r WHERE rank <= 50")
def candidate_pool(spark, d):
    """Fifty named candidates of each query."""
    q, v = _vectors(spark, d)
    return R.build_candidates(q, _named(v)).withColumn("score", F.round("score", 6))


@_query(_KNN_SQL + """, g AS (SELECT vec_id AS qid, vec_id + 7 AS gold FROM v WHERE vec_id % 20 = 0),
h AS (SELECT g.qid, min(rank) AS rank FROM g LEFT JOIN r ON r.qid = g.qid AND r.id = g.gold AND rank <= 50 GROUP BY g.qid)
SELECT count(*) AS n, count(*) FILTER (rank <= 5) AS hits_5, round(count(*) FILTER (rank <= 5) / count(*), 6) AS share_5, count(*) FILTER (rank <= 10) AS hits_10, round(count(*) FILTER (rank <= 10) / count(*), 6) AS share_10 FROM h""")
def candidate_hits(spark, d):
    """How many queries have their gold among the first five and ten of the pool."""
    q, v = _vectors(spark, d)
    return R.candidate_hits(R.build_candidates(q, _named(v)), q.select("qid", (F.col("qid") + 7).alias("gold_id")))


@_query("""WITH v AS (SELECT cast(vec_id AS varchar) AS t, label, cast(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT cast(vec_id AS varchar) AS l, cast(vec_id % 97 AS varchar) AS r, CAST('0x' || substr(md5(cast(vec_id AS varchar)), 1, 8) AS bigint) % 10 < 5 AS valid FROM embeddings),
s AS (SELECT valid, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS label, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 9) AS sim FROM p JOIN v a ON a.t = l JOIN v b ON b.t = r),
sw AS (SELECT k, k / 200.0 AS threshold, count(*) FILTER (sim >= k / 200.0 AND label = 1) AS tp, count(*) FILTER (sim >= k / 200.0) AS predicted, count(*) FILTER (label = 1) AS positives FROM s, (SELECT unnest(range(-200, 201)) AS k) WHERE valid GROUP BY k),
b AS (SELECT threshold, round(coalesce(2.0 * tp / nullif(predicted + positives, 0), 0), 6) AS valid_f1 FROM sw WHERE predicted > 0 OR positives = 0 ORDER BY valid_f1 DESC, k LIMIT 1),
c AS (SELECT count(*) FILTER (sim >= threshold AND label = 1) AS tp, count(*) FILTER (sim >= threshold) AS pr, count(*) FILTER (label = 1) AS po FROM s, b WHERE NOT valid)
SELECT round(coalesce(tp / nullif(pr, 0), 0), 6) AS precision, round(coalesce(tp / nullif(po, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(pr + po, 0), 0), 6) AS f1, threshold, valid_f1 FROM c, b""")
def pair_f1_texts(spark, d):
    """Pairs of ids as texts, each distinct one encoded once (here: looked up) on its side."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("text"), F.col("embedding").alias("vector"), "label")
    named = v.select("text", "label")
    pairs = _t(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("left"), (F.col("vec_id") % 97).cast("string").alias("right"), (X.split_md5_32("vec_id") < 5).alias("valid"))
    labelled = pairs.join(named.toDF("left", "_a"), "left").join(named.toDF("right", "_b"), "right").select("left", "right", "valid", F.when(F.col("_a") == F.col("_b"), 1).otherwise(0).alias("label"))
    valid, test = R.pair_similarities(lambda texts: texts.join(v.select("text", "vector"), "text"), labelled.where("valid"), labelled.where("not valid"))
    return E.pair_f1(valid, test)


@_query("""WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag || l_partkey) AS t FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS r, cast(l_linenumber AS varchar) AS a, t FROM l),
asked AS (SELECT o_orderkey, o_orderkey % 6 AS r, o_orderkey % 3 AS c FROM orders)
SELECT o_orderkey, coalesce(CASE c WHEN 0 THEN a WHEN 1 THEN t END, '') AS text, coalesce(a || ' | ' || t, '') AS row_context,
  CASE WHEN c < 2 AND a IS NOT NULL THEN CASE c WHEN 0 THEN a ELSE t END || ' [SEP] ' || a || ' | ' || t WHEN a IS NOT NULL THEN a || ' | ' || t ELSE ' ' END AS query
FROM asked LEFT JOIN p ON p.l_orderkey = o_orderkey AND p.r = asked.r WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def extracted_cells(spark, d):
    """Labelled cells of nested tables, one for each order with its lines as rows, some out of range."""
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", F.col("l_partkey").cast("string"))).alias("t"))
    cell = lambda c: F.struct(F.col(c).cast("string").alias("text"))
    rows = lines.select("l_orderkey", "l_linenumber", F.array(cell("l_linenumber"), cell("t")).alias("cells"))
    tables = rows.groupBy(F.col("l_orderkey").alias("_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "cells"))), lambda r: r["cells"]).alias("tableData"))
    labels = _t(spark, d, "orders").select(F.col("o_orderkey").alias("table_id"), (F.col("o_orderkey") % 6).cast("int").alias("row"), (F.col("o_orderkey") % 3).cast("int").alias("col"))
    out = M.extract_cells(tables, labels, row_context=True)
    return out.select(F.col("table_id").alias("o_orderkey"), "text", "row_context", X.with_context("text", "row_context").alias("query"))


@_query("""WITH c AS (SELECT p_brand || '/' || p_size AS t, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS c, CASE WHEN p_partkey % 4 = 0 AND p_size % 3 > 0 THEN -1 ELSE p_partkey END AS r, p_partkey, p_name FROM part)
SELECT m.t AS table_id, m.p_partkey AS row, m.c AS col, coalesce(n.r, m.p_partkey) AS n_row, CASE WHEN n.r IS NULL THEN m.p_name ELSE n.p_name END AS n_text
FROM c m LEFT JOIN c n ON n.t = m.t AND n.c = m.c AND n.r >= 0""")
def column_neighbours(spark, d):
    """Parts as cells of a table for each brand and size; each with the data cells of its column, or with itself where there are only headers."""
    second = F.col("p_partkey") % 4 == 0
    header = second & (F.col("p_size") % 3 > 0)
    cells = _t(spark, d, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("table_id"), F.when(second, 1).otherwise(0).alias("col"), F.when(header, -1).otherwise(F.col("p_partkey")).alias("row"), "p_partkey", F.col("p_name").alias("text"))
    return M.column_neighbours(cells.select("table_id", F.col("p_partkey").alias("row"), "col", "text"), M.column_store(cells.drop("p_partkey")))


@_query("""SELECT DISTINCT l_orderkey AS table_id, l_linenumber AS cell, cast(l_linenumber % 2 = 1 AS int) AS entity_mask FROM lineitem""")
def entity_masks(spark, d):
    """Odd lines of each order are its labelled cells, given as an array with nested ids."""
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    odd = lines.where("l_linenumber % 2 = 1").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").cast("string").alias("id"))
    sorted_ = F.array_sort(F.collect_list(F.struct("l_linenumber", "id")))
    graphs = odd.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.transform(sorted_, lambda x: x["l_linenumber"]).alias("labeled_indices"), F.transform(sorted_, lambda x: F.array(x["id"])).alias("target_ent_ids"))
    cells = lines.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("cell")).distinct()
    return M.entity_mask(cells, M.labelled_cells(graphs), ["table_id", "cell"])


@_query(bm25_sql("SELECT DISTINCT p_type AS qid, unnest(regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}_]+')) AS token FROM part WHERE p_size / 50.0 >= 0.5")
        + "SELECT p_partkey, p_brand AS brand, coalesce(CASE WHEN p_size / 50.0 >= 0.5 THEN cast(r.id AS varchar) END, p_type) AS type FROM part LEFT JOIN r ON r.qid = p_type AND r.rank = 1")
def normalized_cells(spark, d):
    """Cells of a likely entity are looked up by BM25 and replaced by the id of the best part; the others stay."""
    p = _t(spark, d, "part")
    wide = p.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))
    likely = M.above_threshold(p.select("p_partkey", F.lit("type").alias("column"), F.col("p_type").alias("cell"), (F.col("p_size") / F.lit(50.0)).alias("p")), "p", 0.5)
    asked = likely.select(F.col("cell").alias("qid"), F.col("cell").alias("text")).distinct()
    best = R.bm25_topk(_part_kb(spark, d), asked, 1).join(_part_kb(spark, d), "id").select(F.col("qid").alias("cell"), F.col("id").cast("string").alias("id"), "name")
    return M.normalize_table(wide, "p_partkey", ["brand", "type"], likely.select("p_partkey", "column", "cell").join(best, "cell"), "id")


@_query("""WITH rows AS (SELECT p_partkey AS abs_row, p_partkey // 100 AS ch, p_name, p_brand FROM part),
gt AS (SELECT l_orderkey, l_linenumber, l_partkey + l_linenumber * 7 AS abs_row, l_linenumber % 3 AS col FROM lineitem),
j AS (SELECT gt.*, gt.abs_row // 100 AS ch, p_name, p_brand, p_name IS NOT NULL AND col < 2 AS ok FROM gt LEFT JOIN rows ON rows.abs_row = gt.abs_row),
a AS (SELECT DISTINCT ch, col FROM j WHERE ok),
k AS (SELECT a.ch, col, rows.abs_row, CASE col WHEN 0 THEN 'title: [M] ' || p_name || ' [/M] | brand: ' || p_brand ELSE 'title: ' || p_name || ' | brand: [M] ' || p_brand || ' [/M]' END AS m,
  row_number() OVER (PARTITION BY a.ch, col ORDER BY md5('42:' || cast(rows.abs_row AS varchar)), rows.abs_row) AS r FROM a JOIN rows ON rows.ch = a.ch),
c AS (SELECT ch, col, string_agg(m, '#' ORDER BY abs_row) AS context FROM k WHERE r <= 4 GROUP BY ch, col)
SELECT l_orderkey, l_linenumber, j.abs_row, CASE WHEN ok THEN CASE j.col WHEN 0 THEN p_name ELSE p_brand END ELSE '' END AS cell_text, CASE WHEN ok THEN 'title: ' || p_name || ' | brand: ' || p_brand ELSE '' END AS row_context,
  CASE WHEN NOT ok THEN '' WHEN j.col = 0 THEN 'title: [M] ' || p_name || ' [/M] | brand: ' || p_brand ELSE 'title: ' || p_name || ' | brand: [M] ' || p_brand || ' [/M]' END AS row_with_marker,
  cast(j.ch AS int) AS chunk_idx, cast(j.abs_row % 100 AS int) AS row_in_chunk, coalesce(context, '') AS context FROM j LEFT JOIN c ON c.ch = j.ch AND c.col = j.col""")
def eval_samples(spark, d):
    """Label positions with marked rows and the context of their columns, in chunks of 100 rows."""
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("abs_row"), F.array("p_name", "p_brand").alias("cells"))
    gt = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + F.col("l_linenumber") * 7).alias("abs_row"), (F.col("l_linenumber") % 3).alias("col"))
    out = S.eval_samples(gt, rows, ["title", "brand"], 4, 42, 100)
    return out.withColumn("context", F.array_join("context", "#")).drop("col")


_TRAINING_SQL = """WITH kb AS (SELECT p_brand AS id, arg_max(p_name, p_partkey) AS name FROM part WHERE p_size > 10 GROUP BY p_brand),
l AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS lid, l_partkey + l_linenumber * 7 AS abs_row, 'Brand#' || (11 + l_partkey % 50) AS id FROM lineitem),
t AS (SELECT lid, l.id, '[COL] title [VAL] ' || p_name || ' [COL] brand [VAL] ' || p_brand AS cell_text, '[COL] name [VAL] ' || kb.name AS entity_text FROM l JOIN part ON p_partkey = abs_row JOIN kb ON kb.id = l.id)
"""


def _training(spark, d):
    p = _t(spark, d, "part")
    kb = p.where("p_size > 10").select(F.concat(F.lit("http://kb/"), "p_brand").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    rows = p.select(F.col("p_partkey").alias("abs_row"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"))
    labels = _t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("lid"), (F.col("l_partkey") + F.col("l_linenumber") * 7).alias("abs_row"), F.concat(F.lit("x/Brand#"), (11 + F.col("l_partkey") % 50).cast("string")).alias("id")).distinct()
    return labels, M.training_cells(labels, rows, kb)


@_query(_TRAINING_SQL + "SELECT *, dense_rank() OVER (ORDER BY id) - 1 AS label FROM t")
def training_cells(spark, d):
    """Labelled cells and entities as texts, with the place of their entity among the sorted ones."""
    return _training(spark, d)[1]


@_query(_TRAINING_SQL + "SELECT count(*) AS pairs, count(DISTINCT id) AS clusters, round(count(*) / count(DISTINCT id), 6) AS per_cluster, (SELECT count(*) FROM l WHERE lid NOT IN (SELECT lid FROM t)) AS unmatched FROM t")
def training_stats(spark, d):
    """The counts of training_cells, with the labels that found no row or entity."""
    labels, cells = _training(spark, d)
    return E.training_stats(labels, cells, "id", "lid")


@_query(_KNN_SQL + """, b AS (SELECT qid, string_agg(id, ',' ORDER BY rank) AS top_ids, string_agg('v' || id, ',' ORDER BY rank) AS top_names, min(CASE WHEN rank = 1 THEN id END) AS top1_id, round(min(CASE WHEN rank = 1 THEN score END), 6) AS top1_score FROM r WHERE rank <= 5 GROUP BY qid),
x AS (SELECT q.vec_id AS qid, string_agg('v' || o.vec_id, ',' ORDER BY o.vec_id) AS row_context FROM v q JOIN v o ON o.vec_id // 10 = q.vec_id // 10 AND o.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id)
SELECT b.qid, b.qid + 7 AS gold_id, g.n AS gold_name, top1_id, 'v' || top1_id AS top1_name, top1_score, top_ids, top_names, coalesce(row_context, '') AS row_context
FROM b LEFT JOIN (SELECT vec_id AS id, 'v' || vec_id AS n FROM v) g ON g.id = b.qid + 7 LEFT JOIN x ON x.qid = b.qid""")
def diagnosis(spark, d):
    """For each query its five best candidates with names, the gold's name and the other cells of its row."""
    q, v = _vectors(spark, d)
    cells = v.select(F.lit("t").alias("table_id"), F.floor(F.col("id") / 10).alias("row"), (F.col("id") % 10).alias("col"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("text"))
    gold = q.select("qid", (F.col("qid") + 7).alias("gold_id"), F.lit("t").alias("table_id"), F.floor(F.col("qid") / 10).alias("row"), (F.col("qid") % 10).alias("col"))
    out = R.diagnose(R.knn_topk(q, v, 5), gold, _named(v), cells)
    lists = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("top_ids", "top_names", "row_context")}
    return out.withColumn("top1_score", F.round("top1_score", 6)).withColumns(lists)


def _plain(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')"


@_query(f"""WITH n AS (SELECT o_custkey AS k, o_orderkey AS pos, lower(o_orderpriority) AS gold, o_orderpriority AS a, upper(o_orderstatus) AS b, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS c FROM orders),
l AS (SELECT k, arg_max(gold, pos) AS gold, arg_max(a, pos) AS a, arg_max(b, pos) AS b, arg_max(c, pos) AS c FROM n GROUP BY k),
m AS (SELECT k, {_plain('a')} = {_plain('gold')} AS a, {_plain('b')} = {_plain('gold')} AS b, c <> '' AND {_plain('c')} = {_plain('gold')} AS c FROM l WHERE gold <> '')
SELECT CASE WHEN a AND b AND c THEN 'all_correct' WHEN NOT (a OR b OR c) THEN 'all_wrong' WHEN a AND NOT b AND NOT c THEN 'only_a' ELSE 'mixed' END AS bucket, count(*) AS n FROM m GROUP BY 1""")
def name_buckets(spark, d):
    """Three dumps compared by name, the last order of each customer counts."""
    o = _t(spark, d, "orders")
    gold = F.lower("o_orderpriority").alias("gold_name")
    one = lambda name: o.select("o_custkey", F.col("o_orderkey").alias("pos"), gold, name.alias("top1_name"))
    third = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))
    dumps = [one(F.col("o_orderpriority")), one(F.upper("o_orderstatus")), one(third)]
    return E.bucket_counts(E.name_cases(*dumps, key=["o_custkey"]))


@_query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type")
def class_summary(spark, d):
    """Size and mean of each class."""
    return E.class_summary(_t(spark, d, "events"), "value", "event_type")


@_query("""SELECT DISTINCT l_orderkey, l_linenumber, 1 / (1 + exp(-round(cast(l_discount AS double), 6))) AS sigmoid, cast((l_partkey // 100) AS int) AS chunk_idx, cast(l_partkey % 100 AS int) AS row_in_chunk, 3.0 / 5 AS third, exp(-1.0) / (1 + exp(-1.0)) AS share, CASE WHEN length(l_returnflag || l_partkey) <= 5 THEN l_returnflag || l_partkey ELSE substr(l_returnflag || l_partkey, 1, 3) || '..' END AS short FROM lineitem""")
def scalars(spark, d):
    """P21, P23 to P25, W4 on lines."""
    three, two = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0))
    chunk, row = io.row_address("l_partkey", 100)
    out = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.sigmoid(F.round(F.col("l_discount").cast("double"), 6)).alias("sigmoid"), chunk, row, V.l2_normalize(three)[0].alias("third"), V.softmax(two)[1].alias("share"), X.truncate(F.concat("l_returnflag", F.col("l_partkey").cast("string")), 5).alias("short"))
    return out.distinct()


@_query("""WITH v AS (SELECT vec_id, cast(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT vec_id, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM v),
s AS (SELECT vec_id, sqrt(sum(x * x)) AS n, max(x) AS m FROM x GROUP BY vec_id),
t AS (SELECT vec_id, sum(exp(x - m)) AS z FROM x JOIN s USING (vec_id) GROUP BY vec_id)
SELECT vec_id, round(sum(i * x / n), 6) AS normalized, round(sum(i * exp(x - m) / z), 6) AS softmax FROM x JOIN s USING (vec_id) JOIN t USING (vec_id) GROUP BY vec_id""")
def vector_scalars(spark, d):
    """P21, P23 on the vectors: sums of what normalising and softmax give at each place, weighted by the place."""
    v = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    weighted = lambda x: F.aggregate(F.transform(x, lambda y, i: y * (i + 1)), F.lit(0.0), lambda s, y: s + y)
    return v.select("vec_id", F.round(weighted(V.l2_normalize("v")), 6).alias("normalized"), F.round(weighted(V.softmax("v")), 6).alias("softmax"))


@_query("""SELECT 'cust:' || c_custkey AS id, c_name AS name, 'customer' AS type FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'a' || replace(n_name, ' ', '_'), replace(n_name, '_', ' '), 'nation' FROM nation""")
def entity_tables(spark, d):
    """Entities of the id and name columns of two tables; rows with a blank name are dropped."""
    c = _t(spark, d, "customer").withColumn("name", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")))
    n = _t(spark, d, "nation").select(F.translate("n_name", " ", "_").alias("key"), X.readable_title("n_name").alias("title"))
    return io.kb_from_table(M.drop_blank(c, "name"), "c_custkey", "name", "customer", "cust:").unionByName(io.kb_from_table(n, "key", "title", "nation", "a"))


@_query("""WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+')) AS a, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[\\p{L}\\p{N}_]+')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score FROM t""")
def pair_scores(spark, d):
    """The word overlap of each part's name and its name with its type."""
    rows = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat_ws(" ", "p_name", "p_type").alias("b"))
    return R.score_pairs(rows, "a", "b").select("p_partkey", F.round("score", 6).alias("score"))


@_query("""WITH c AS (SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10)) AS text, trim(role) || ' | ' || trim(text, ' ' || chr(9) || chr(10)) AS row_text FROM conversations)
SELECT cast(conv_id AS varchar) AS table_id, turn AS row, 1 AS col, text, role AS title, row_text, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'valid' ELSE 'test' END AS split
FROM (SELECT *, CAST('0x' || substr(md5(cast(conv_id AS varchar)), 1, 8) AS bigint) % 10 AS b FROM c) WHERE text <> '' AND role <> ''""")
def linked_cells(spark, d):
    """The linked cells themselves, with the text of their row and their split."""
    return wikitables.linked_cells(_linked_turns(spark, d))


@_query("""SELECT role AS id, replace(role, '_', ' ') AS name FROM conversations WHERE role <> '' AND trim(text, ' ' || chr(9) || chr(10)) <> '' GROUP BY role""")
def linked_kb(spark, d):
    """One entity for each linked title."""
    return wikitables.kb_of_links(wikitables.linked_cells(_linked_turns(spark, d))).select("id", "name")
