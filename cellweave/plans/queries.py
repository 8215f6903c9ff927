"""The registered queries of the alignment operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import cosine
from ..operators import evaluation as E
from ..operators import matching as M
from ..operators import retrieval as R
from ..operators import sampling as S
from ..sources import io
from . import wikitables

#: Every row whose id is divisible by this is a query of a search, against all rows, where not all are.
QUERY_STEP = 20
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# parts as a knowledge base; mentions are the parts that lineitem names, without the last word
_PART_NAME = "concat_ws(' ', p_name, replace(p_brand, '#', ''), p_type, cast(p_size as string))"


def _part_kb(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(_PART_NAME).alias("name"))


def _mentions(spark, d):
    named = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct().join(_part_kb(spark, d), "id")
    return named.select(F.col("id").alias("qid"), F.regexp_replace("name", r" \S+$", "").alias("text"))


def bm25_sql(asked: str) -> str:
    """The head of a statement: ranks r(qid, rank, id, score) of parts for the words q(qid, token) that the query `asked` gives."""
    return f"""
WITH kb AS (SELECT p_partkey AS id, concat_ws(' ', p_name, replace(p_brand, '#', ''), p_type, cast(p_size AS varchar)) AS name FROM part),
tok AS (SELECT id, regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}_]+') AS t FROM kb),
size AS (SELECT count(*) AS n, avg(len(t)) AS al FROM tok),
tf AS (SELECT id, token, count(*) AS tf, any_value(l) AS l FROM (SELECT id, len(t) AS l, unnest(t) AS token FROM tok) GROUP BY id, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
q AS ({asked}),
s AS (SELECT qid, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / al))), 6) AS score
      FROM q JOIN tf USING (token) JOIN df USING (token), size GROUP BY qid, id),
r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, id, score FROM s)
"""


#: The words of the mentions.
_BM25_SQL = bm25_sql("""SELECT DISTINCT id AS qid, unnest(regexp_extract_all(lower(regexp_replace(name, ' \\S+$', '')), '[\\p{L}\\p{N}_]+')) AS token
      FROM kb WHERE id IN (SELECT l_partkey FROM lineitem)""")


@_query(_BM25_SQL + "SELECT qid, rank, id, score FROM r WHERE rank <= 10")
def bm25_topk(spark, d):
    """The ten best parts of each mention."""
    return R.bm25_topk(_part_kb(spark, d), _mentions(spark, d), 10)


_METRIC_SQL = """
SELECT count(*) AS n, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6) AS micro_f1,
       round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_10,
       round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_10
"""


@_query(_BM25_SQL + _METRIC_SQL + "FROM (SELECT q.qid, min(CASE WHEN r.id = q.qid AND r.rank <= 10 THEN r.rank END) AS rank FROM (SELECT DISTINCT qid FROM q) q LEFT JOIN r USING (qid) GROUP BY q.qid)")
def bm25_eval(spark, d):
    """The metrics of bm25_topk."""
    q = _mentions(spark, d)
    return E.ranking_metrics(q.select("qid", F.col("qid").cast("string").alias("gold_id")), R.bm25_topk(_part_kb(spark, d), q, 10).withColumn("id", F.col("id").cast("string")))


@_query("""SELECT page_id, list_extract(string_split(url, '/'), -1) AS last_segment,
  lower(trim(regexp_replace(regexp_replace(replace(string_split(CASE WHEN contains(url, '://') THEN list_extract(string_split(list_extract(string_split(url, '/'), -1), ':'), -1) ELSE url END, '(')[1], '_', ' '), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))) AS entity_id FROM pages""")
def normalize_ids(spark, d):
    """P1, P2 on the URLs of pages."""
    return _t(spark, d, "pages").select("page_id", X.last_segment("url").alias("last_segment"), X.normalize_entity_id("url").alias("entity_id"))


@_query("""SELECT p_partkey, 'title: ' || p_name || ' | brand: ' || p_brand AS context, 'COL title VAL ' || p_name || ' COL brand VAL ' || p_brand AS ditto,
  '[COL] title [VAL] ' || p_name || ' [COL] brand [VAL] ' || p_brand AS bracket, 'title: ' || p_name || ' | brand: ' || p_brand AS stripped,
  p_name AS title, p_brand AS brand, 'a: [M] ' || p_name || ' [/M] | b: ' || p_brand AS marked0, 2 AS depth FROM part""")
def serialise_rows(spark, d):
    """P6, P7, P10 to P14 on the rows of part."""
    rows = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), "p_type")
    rows = rows.withColumns({"context": X.row_context(["title", "brand"]), "bracket": X.ser_bracket("title", "brand")})
    parsed = X.parse_row_context("context", F.lit(""))
    marked = X.marked_row(F.array("title", "brand"), F.array(F.lit("a"), F.lit("b")), F.lit(0))
    return rows.select("p_partkey", "context", X.ser_ditto("title", "brand").alias("ditto"), "bracket", X.strip_colval("bracket").alias("stripped"), parsed["title"].alias("title"), parsed["brand"].alias("brand"), marked.alias("marked0"), X.path_depth(F.concat_ws(" > ", "p_type", "brand", "title")).alias("depth"))


@_query("""WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, 'pick [' || cast(l_linenumber AS varchar) || '] of ' || l_returnflag AS reply FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 5 THEN l_linenumber END AS bracket, CASE WHEN l_linenumber <= 5 THEN l_linenumber END AS bare, CASE WHEN l_linenumber <= 5 THEN l_linenumber END AS digits FROM r""")
def parse_replies(spark, d):
    """P18, X5 on replies made of line numbers."""
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("pick ["), F.col("l_linenumber").cast("string"), F.lit("] of "), F.col("l_returnflag")).alias("reply")).distinct()
    return rows.select("l_orderkey", "l_linenumber", *(X.parse_reply("reply", 5, s).alias(s) for s in X.REPLY_STYLES))


@_query("""WITH s AS (SELECT CAST('0x' || substr(md5(cast(o_orderkey AS varchar)), 1, 8) AS bigint) % 10 AS short, ((CAST('0x' || substr(md5(cast(o_orderkey AS varchar)), 1, 16) AS ubigint) % 10) * 6 + CAST('0x' || substr(md5(cast(o_orderkey AS varchar)), 17, 16) AS ubigint) % 10) % 10 AS whole FROM orders)
SELECT cast(short AS bigint) AS short, cast(whole AS bigint) AS whole, count(*) AS n FROM s GROUP BY ALL""")
def split_counts(spark, d):
    """N1, N2 on the keys of orders."""
    return _t(spark, d, "orders").groupBy(X.split_md5_32("o_orderkey").alias("short"), X.split_md5_128("o_orderkey").alias("whole")).agg(F.count("*").alias("n"))


@_query("""SELECT 'cluster:' || p_brand || '/' || cast(p_size AS varchar) AS id, arg_min(p_name, p_partkey) AS name, arg_min(p_name, p_partkey) AS title, arg_min(p_name, p_partkey) AS text, 'product' AS type, '' AS path FROM part WHERE p_name IS NOT NULL GROUP BY p_brand, p_size""")
def cluster_kb(spark, d):
    """One entity per brand and size, by its first part."""
    p = _t(spark, d, "part")
    return M.build_cluster_kb(p.select(F.col("p_partkey").alias("abs_row"), F.col("p_name").alias("title")), p.select(F.col("p_partkey").alias("abs_row"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("label")))


@_query("""WITH u AS (SELECT 0 AS s, c_custkey AS pos, cast(c_nationkey AS varchar) AS id, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, cast(s_nationkey AS varchar), s_name FROM supplier)
SELECT id, arg_min(pos, s * 1000000000000 + pos) AS pos, arg_min(name, s * 1000000000000 + pos) AS name FROM u GROUP BY id""")
def kb_union_dedupe(spark, d):
    """Customers and suppliers by nation, the first one wins."""
    c = _t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("pos"))
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("pos"))
    return M.union_kb(c, s)


@_query("""WITH kb AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'http://kb/' || n_name ELSE lower(n_name) END AS id, n_nationkey AS pos FROM nation),
keys AS (SELECT pos, unnest([0, 1, 2, 3]) AS no, unnest([id, list_extract(string_split(id, '/'), -1), lower(id), lower(list_extract(string_split(id, '/'), -1))]) AS key FROM kb),
entered AS (SELECT key, arg_max(pos, pos * 10 + no) AS pos FROM keys GROUP BY key),
lab AS (SELECT c_custkey AS lid, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'http://other/' || n_name ELSE 'none of ' || n_name END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey),
asked AS (SELECT lid, unnest([0, 1, 2, 3]) AS no, unnest([label, list_extract(string_split(label, '/'), -1), lower(label), lower(list_extract(string_split(label, '/'), -1))]) AS key FROM lab)
SELECT lid, arg_min(pos, no) AS pos FROM asked JOIN entered USING (key) GROUP BY lid""")
def four_key_match(spark, d):
    """Labels of customers against nations whose ids have several forms."""
    n = _t(spark, d, "nation")
    kb = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("http://kb/"), "n_name")).otherwise(F.lower("n_name")).alias("id"), F.col("n_nationkey").alias("pos"))
    form = F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("http://other/"), "n_name")).otherwise(F.concat(F.lit("none of "), "n_name"))
    labels = _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("lid"), form.alias("label"))
    return M.match_entities(labels, kb)


@_query("""SELECT l_orderkey, l_linenumber, l_partkey + l_linenumber * 7 AS abs_row, coalesce(CASE WHEN l_linenumber % 3 = 0 THEN p_name WHEN l_linenumber % 3 = 1 THEN p_brand END, '') AS cell_text,
  coalesce('title: ' || p_name || ' | brand: ' || p_brand, '') AS row_context FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + l_linenumber * 7""")
def gt_row_join(spark, d):
    """Label positions against the rows of part; some are out of range."""
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("abs_row"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand")).select("abs_row", F.array("title", "brand").alias("cells"), X.row_context(["title", "brand"]).alias("row_context"))
    gt = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + F.col("l_linenumber") * 7).alias("abs_row"), (F.col("l_linenumber") % 3).alias("col"))
    return M.attach_rows(gt, rows).drop("col")


@_query("SELECT count(p_partkey) AS matched, count(*) - count(p_partkey) AS unmatched FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + l_linenumber * 7")
def unmatched(spark, d):
    """F8: label ids that the knowledge base lacks."""
    gt = _t(spark, d, "lineitem").select((F.col("l_partkey") + F.col("l_linenumber") * 7).alias("id"))
    return M.matched_only(gt, _part_kb(spark, d), "id")[1]


def knn_sql(asked: str) -> str:
    """The head of a statement: ranks r(qid, rank, id, score) of all vectors for the vectors q that the condition `asked` takes."""
    return f"""
WITH v AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
s AS (SELECT q.vec_id AS qid, k.vec_id AS id, round(list_dot_product(q.e, k.e) / (q.n * k.n), 9) AS score FROM u q JOIN u k ON {asked}),
r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, id, score FROM s)
"""


_KNN_SQL = knn_sql("q.vec_id % 20 = 0")
#: Every vector is a query.
_KNN_ALL_SQL = knn_sql("true")


def _vectors(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return v.where(F.col("id") % QUERY_STEP == 0).select(F.col("id").alias("qid"), "vector", "label"), v


def _all_vectors(spark, d):
    v = _vectors(spark, d)[1]
    return v.withColumnRenamed("id", "qid"), v


@_query(_KNN_ALL_SQL + "SELECT qid, rank, id, round(score, 6) AS score FROM r WHERE rank <= 10")
def knn_topk(spark, d):
    """Exact cosine top ten of every vector."""
    q, v = _all_vectors(spark, d)
    return R.knn_topk(q, v, 10).withColumn("score", F.round("score", 6))


@_query(_KNN_ALL_SQL + ", c AS (SELECT qid, rank, k.label = q.label AS hit FROM r JOIN v q ON q.vec_id = qid JOIN v k ON k.vec_id = id WHERE rank BETWEEN 2 AND 11)" + _METRIC_SQL + "FROM (SELECT qid, min(CASE WHEN hit THEN rank - 1 END) AS rank FROM c GROUP BY qid)")
def knn_label_eval(spark, d):
    """R2, A1, A4: whether the nearest others of every vector share the label."""
    q, v = _all_vectors(spark, d)
    found = R.knn_topk(q, v, 11).where("rank > 1").join(v.select("id", F.col("label").cast("string").alias("_l")), "id").select("qid", (F.col("rank") - 1).alias("rank"), F.col("_l").alias("id"))
    return E.ranking_metrics(q.select("qid", F.col("label").cast("string").alias("gold_id")), found, normalise=False)


@_query()
def knn_lsh_recall(spark, d):
    """The share of the exact best ten that the approximate search finds."""
    q, v = _vectors(spark, d)
    exact, near = R.knn_topk(q, v, 10), R.knn_topk_lsh(q, v, 10)
    return exact.join(near.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left").agg(F.count("*").alias("n"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


@_query(_KNN_SQL + """, c AS (SELECT qid, id, rank AS old, round(CASE WHEN k.label = q.label THEN 1 ELSE 0 END + 0.5 / rank, 6) AS score FROM r JOIN v q ON q.vec_id = qid JOIN v k ON k.vec_id = id WHERE rank <= 50)
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old) AS rank, id, score FROM c) WHERE rank <= 10""")
def rerank_scores(spark, d):
    """Fifty candidates rescored by label and cut to ten."""
    q, v = _vectors(spark, d)
    found = R.knn_topk(q, v, 50)
    scores = found.join(q.select("qid", F.col("label").alias("a")), "qid").join(v.select("id", F.col("label").alias("b")), "id").select("qid", "id", F.round(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0) + 0.5 / F.col("rank"), 6).alias("score"))
    return R.rerank(found, scores, 10)


_PAIR_SQL = """
WITH v AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS label, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) AS sim,
      CAST('0x' || substr(md5(cast(a.vec_id AS varchar)), 1, 8) AS bigint) % 10 < 5 AS valid FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
sw AS (SELECT k, k / 200.0 AS threshold, count(*) FILTER (sim >= k / 200.0 AND label = 1) AS tp, count(*) FILTER (sim >= k / 200.0) AS predicted, count(*) FILTER (label = 1) AS positives FROM p, (SELECT unnest(range(-200, 201)) AS k) WHERE valid GROUP BY k),
f AS (SELECT cast(k AS int) AS k, threshold, tp, predicted, positives, round(coalesce(2.0 * tp / nullif(predicted + positives, 0), 0), 6) AS f1 FROM sw)
"""


def _pairs(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", "label", "embedding")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("_l"), F.col("embedding").alias("_e"))
    return v.join(b, "vec_id").select("vec_id", F.when(F.col("label") == F.col("_l"), 1).otherwise(0).alias("label"), F.round(cosine("embedding", "_e"), 6).alias("sim"), (X.split_md5_32("vec_id") < 5).alias("valid"))


@_query(_PAIR_SQL + "SELECT k, threshold, tp, predicted, positives, f1 FROM f")
def threshold_sweep(spark, d):
    """All 401 thresholds."""
    return E.threshold_sweep(_pairs(spark, d).where("valid"), "sim", "label")


@_query(_PAIR_SQL + """, b AS (SELECT threshold, f1 AS valid_f1 FROM f WHERE predicted > 0 OR positives = 0 ORDER BY f1 DESC, k LIMIT 1),
c AS (SELECT count(*) FILTER (sim >= threshold AND label = 1) AS tp, count(*) FILTER (sim >= threshold) AS pr, count(*) FILTER (label = 1) AS po FROM p, b WHERE NOT valid)
SELECT round(coalesce(tp / nullif(pr, 0), 0), 6) AS precision, round(coalesce(tp / nullif(po, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(pr + po, 0), 0), 6) AS f1, threshold, valid_f1 FROM c, b""")
def pair_f1(spark, d):
    """Tuned on one half of the pairs, applied to the other."""
    p = _pairs(spark, d)
    return E.pair_f1(p.where("valid"), p.where("not valid"))


@_query()
def embed_hash(spark, d):
    """Documents encoded by the default encoder, each distinct text once; the digest of the vector."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return R.embed_stored(docs, "text", f"{io.scratch(spark, 'vectors')}/stored").select("doc_id", F.size("vector").alias("dim"), F.md5(F.to_json(F.struct("vector"))).alias("digest"))


@_query("""WITH o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 20 = 0 THEN 0 ELSE 1 END AS g, md5('3:' || cast(p_partkey AS varchar)) AS h FROM part),
r AS (SELECT id, row_number() OVER (ORDER BY g, h, id) AS r FROM o) SELECT scale, id FROM r, (SELECT unnest([150, 300, 600]) AS scale) WHERE r <= scale""")
def scale_subsets(spark, d):
    """Gold parts filled up to three sizes."""
    kb = _t(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return S.scale_subsets(kb, kb.where(F.col("id") % QUERY_STEP == 0), [150, 300, 600], 3)


@_query("""WITH r AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY md5('5:' || cast(p_partkey AS varchar)), p_partkey) AS r FROM part)
SELECT p_brand, string_agg(p_name, ' | ' ORDER BY p_partkey) AS context FROM r WHERE r <= 8 GROUP BY p_brand""")
def column_context(spark, d):
    """Up to eight names of each brand in row order."""
    return S.column_context(_t(spark, d, "part"), ["p_brand"], "p_partkey", "p_name", 8, 5)


@_query(_KNN_SQL + """, pos AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS o FROM v WHERE vec_id % 20 = 0),
seen AS (SELECT r.id, min(o * 1000 + rank) AS place FROM r JOIN pos ON pos.id = qid WHERE rank <= 8 AND r.id NOT IN (SELECT id FROM pos) GROUP BY r.id),
hard AS (SELECT cast(row_number() OVER (ORDER BY place, id) AS int) AS rank, id, 'hard' AS kind FROM seen),
h AS (SELECT * FROM hard WHERE rank <= 72),
fill AS (SELECT cast((SELECT count(*) FROM h) + row_number() OVER (ORDER BY md5('9:' || cast(vec_id AS varchar)), vec_id) AS int) AS rank, vec_id AS id, 'random' AS kind FROM v WHERE vec_id NOT IN (SELECT id FROM pos) AND vec_id NOT IN (SELECT id FROM h))
SELECT rank, id, kind FROM h UNION ALL SELECT rank, id, kind FROM fill WHERE rank <= 96""")
def hard_negatives(spark, d):
    """72 neighbours that aren't positives, then random ones up to 96."""
    q, v = _vectors(spark, d)
    near = R.knn_topk(q, v, 8).select(F.col("qid").alias("id"), "rank", F.col("id").alias("other"))
    return S.hard_negatives(q.select(F.col("qid").alias("pos_order"), F.col("qid").alias("id")), near, v, 96, 0.25, 9)


@_query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity > 25 AS a, l_discount > 0.05 AS b, l_tax > 0.04 AS c FROM lineitem),
k AS (SELECT l_orderkey, l_linenumber, bool_or(a) AS a, bool_or(b) AS b, bool_or(c) AS c FROM m GROUP BY ALL)
SELECT CASE WHEN a AND b AND c THEN 'all_correct' WHEN NOT (a OR b OR c) THEN 'all_wrong' WHEN a AND NOT b AND NOT c THEN 'only_a' ELSE 'mixed' END AS bucket, count(*) AS n FROM k GROUP BY 1""")
def error_buckets(spark, d):
    """Three judgements of the same lines."""
    m = _t(spark, d, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    one = [m.select(*key, c.alias("correct")) for c in (F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04)]
    return E.bucket_counts(E.error_buckets(*one, key=key))


@_query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, min(value) FILTER (r = n // 2 + 1) AS median, min(value) FILTER (r = n * 95 // 100 + 1) AS p95 FROM r GROUP BY event_type""")
def latency_summary(spark, d):
    """A16 on the values of events."""
    return E.latency_summary(_t(spark, d, "events"), "value", "event_type")


@_query("""SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50 FROM events GROUP BY event_type""")
def quantiles(spark, d):
    """A17 on the values of events."""
    return E.quantile_stats(_t(spark, d, "events"), "value", "event_type")


@_query("""WITH g AS (SELECT event_type, unnest(range(0, 50)) AS bin FROM (SELECT DISTINCT event_type FROM events)),
c AS (SELECT event_type, least(cast(floor(value * 50 / 100.0) AS int), 49) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY ALL)
SELECT event_type, cast(bin AS int) AS bin, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (event_type, bin)""")
def histogram(spark, d):
    """A18 on the values of events."""
    return E.histogram(_t(spark, d, "events"), "value", "event_type", 0.0, 100.0, 50)


@_query("""SELECT DISTINCT event_type, value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS ecdf FROM events WHERE value IS NOT NULL""")
def ecdf(spark, d):
    """W5 on the values of events."""
    return E.ecdf(_t(spark, d, "events"), "value", "event_type")


@_query("""WITH c AS (SELECT vec_id // 10 AS r, vec_id % 10 AS k, cast(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT r, k, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM c),
rm AS (SELECT r, i, avg(x) AS m FROM x GROUP BY r, i), cm AS (SELECT k, i, avg(x) AS m FROM x GROUP BY k, i)
SELECT r AS row, k AS col, round(sum(i * (0.8 * x + 0.2 * (0.75 * rm.m + 0.25 * cm.m))), 6) AS checksum FROM x JOIN rm USING (r, i) JOIN cm USING (k, i) GROUP BY r, k""")
def structure_mix(spark, d):
    """A12, G1 to G3 on the vectors as one table of ten columns; a weighted sum of each result."""
    cells = _t(spark, d, "embeddings").select(F.lit("t").alias("table_id"), F.floor(F.col("vec_id") / 10).alias("row"), (F.col("vec_id") % 10).alias("col"), F.col("embedding").cast("array<double>").alias("v"))
    out = M.structure_mix(cells, "v", 0.75, 0.2)
    total = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select("row", "col", F.round(total, 6).alias("checksum"))


@_query("""WITH f AS (SELECT p_brand AS cell, min(p_name) AS name FROM part WHERE p_size < 10 GROUP BY p_brand)
SELECT p_partkey, coalesce(f.name, p_brand) AS brand, p_type AS type FROM part LEFT JOIN f ON cell = p_brand""")
def normalize_table(spark, d):
    """R9, the join and the pivot: cells of a wide table replaced by the names found for them."""
    p = _t(spark, d, "part")
    found = p.where("p_size < 10").select(F.col("p_brand").alias("cell"), F.col("p_name").alias("name"))
    return M.normalize_table(p.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type")), "p_partkey", ["brand", "type"], found)


@_query("""WITH c AS (SELECT conv_id, turn, role, trim(text, ' ' || chr(9) || chr(10)) AS text FROM conversations),
l AS (SELECT conv_id, CAST('0x' || substr(md5(cast(conv_id AS varchar)), 1, 8) AS bigint) % 10 AS b, role FROM c WHERE text <> '' AND role <> '')
SELECT (SELECT count(DISTINCT conv_id) FROM c) AS tables, (SELECT 2 * count(*) FROM c) AS cells, count(*) AS linked_cells, count(DISTINCT role) AS entities,
  count(*) FILTER (b < 8) AS train, count(*) FILTER (b = 8) AS valid, count(*) FILTER (b = 9) AS test FROM l""")
def wikitables_prep(spark, d):
    """The counters of conversations as tables, one row for each turn, with a link in each text cell."""
    rows = _linked_turns(spark, d)
    return wikitables.prep_stats(rows, wikitables.linked_cells(rows))


def _linked_turns(spark, d):
    link = F.struct(F.struct(F.col("role").alias("title")).alias("target"))
    none = F.filter(F.array(link), lambda x: F.lit(False))
    cell = lambda t, links: F.struct(F.col(t).alias("text"), links.alias("surfaceLinks"))
    return _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("table_id"), F.col("turn").cast("long").alias("row"), F.array(cell("role", none), cell("text", F.array(link))).alias("cells"))
