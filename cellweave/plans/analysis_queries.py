"""More registered queries: names, replies, neighbours, samples, run audits and scale curves over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import matching as M
from ..operators import retrieval as R
from ..operators import sampling as S
from .queries import _KNN_SQL, QUERY_STEP, _query, _t, _vectors

_REPLY = "CASE WHEN o_orderkey % 11 = 0 THEN 'ERROR: timeout' ELSE 'pick [' || cast(o_orderkey % 9 AS {0}) || ']' END"
_PICK_SQL = "CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 9 BETWEEN 1 AND 7 THEN o_orderkey % 9 END"


@_query("""SELECT round(avg(CASE WHEN lower(coalesce(p.n_name, cast(c_nationkey AS varchar))) = lower(coalesce(g.n_name, cast(c_custkey % 30 AS varchar))) THEN 1.0 ELSE 0 END), 6) AS name_accuracy,
  round(avg(CASE WHEN lower(coalesce(p.n_name, cast(c_nationkey AS varchar))) = lower(coalesce(g.n_name, cast(c_custkey % 30 AS varchar))) THEN 1.0 ELSE 0 END), 6) AS name_micro_f1
FROM customer LEFT JOIN nation p ON p.n_nationkey = c_nationkey LEFT JOIN nation g ON g.n_nationkey = c_custkey % 30""")
def name_eval(spark, d):
    """Nations of customers against a guess; ids without a name stand for themselves."""
    kb = _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    c = _t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("predicted"), (F.col("c_custkey") % 30).cast("string").alias("gold"))
    named = M.attach_names(M.attach_names(c, kb, "predicted", "predicted_name"), kb, "gold", "gold_name")
    return E.name_metrics(named, "predicted_name", "gold_name")


def _replies(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.expr(_REPLY.format("string")).alias("reply"), (F.col("o_orderkey") % 100).alias("prompt_tokens"), (F.col("o_orderkey") % 7).alias("completion_tokens"))


@_query(f"""WITH p AS (SELECT o_orderkey AS qid, {_PICK_SQL} AS pick FROM orders)
SELECT l_orderkey AS qid, l_partkey AS id, pick IS NULL AS abstained FROM lineitem LEFT JOIN p ON qid = l_orderkey WHERE l_linenumber = coalesce(pick, 1)""")
def reply_selection(spark, d):
    """The line of each order that a reply picks, the first one where it abstains."""
    cands = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("id"))
    return R.select_from_replies(cands, _replies(spark, d).select("qid", X.parse_reply("reply", 7).alias("pick")))


@_query(f"""SELECT count(*) AS replies, count(*) FILTER (o_orderkey % 11 <> 0 AND ({_PICK_SQL}) IS NULL) AS abstained, count(*) FILTER (o_orderkey % 11 = 0) AS errors,
  cast(coalesce(sum(o_orderkey % 100), 0) AS bigint) AS prompt_tokens, cast(coalesce(sum(o_orderkey % 7), 0) AS bigint) AS completion_tokens FROM orders""")
def reply_counts(spark, d):
    """A15 on one reply for each order."""
    return R.reply_stats(_replies(spark, d), X.parse_reply("reply", 7))


@_query("SELECT count(*) AS pairs, count(DISTINCT p_brand) AS clusters, round(count(*) / count(DISTINCT p_brand), 6) AS per_cluster FROM part")
def cluster_counts(spark, d):
    """Parts by brand."""
    return E.cluster_stats(_t(spark, d, "part"), "p_brand")


@_query(_KNN_SQL + """, t AS (SELECT qid, id, exp(score) / sum(exp(score)) OVER (PARTITION BY qid) AS w FROM r WHERE rank <= 3),
x AS (SELECT vec_id AS id, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM v)
SELECT qid, round(sum(i * w * x), 6) AS checksum FROM t JOIN x USING (id) GROUP BY qid""")
def context_vectors(spark, d):
    """The three nearest vectors weighted by the softmax of their scores; a weighted sum of each result."""
    q, v = _vectors(spark, d)
    mixed = R.context_vector(R.knn_topk(q, v, 3), v)
    total = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return mixed.select("qid", F.round(total, 6).alias("checksum"))


@_query(_KNN_SQL + """SELECT qid, min(CASE WHEN rank = 1 THEN id END) AS top1_id, round(min(CASE WHEN rank = 1 THEN score END), 6) AS top1_score,
  string_agg(id, ',' ORDER BY rank) AS top5_ids FROM r WHERE rank <= 5 GROUP BY qid""")
def topk_dump(spark, d):
    """R16, the lists: one row per query with its best candidate and the ids of the five best."""
    q, v = _vectors(spark, d)
    out = R.dump_topk(R.knn_topk(q, v, 5), 5)
    return out.select("qid", "top1_id", F.round("top1_score", 6).alias("top1_score"), F.array_join("top5_ids", ",").alias("top5_ids"))


_SCALES = [100, 200, 400]


@_query(_KNN_SQL + """, o AS (SELECT vec_id AS id, CASE WHEN vec_id % 20 = 0 THEN 0 ELSE 1 END AS g, md5('3:' || cast(vec_id AS varchar)) AS h FROM v),
n AS (SELECT id, row_number() OVER (ORDER BY g, h, id) AS n FROM o), sub AS (SELECT scale, id FROM n, (SELECT unnest([100, 200, 400]) AS scale) WHERE n <= scale),
c AS (SELECT scale, qid, s.id, row_number() OVER (PARTITION BY scale, qid ORDER BY score DESC, s.id) AS place FROM s JOIN sub ON sub.id = s.id WHERE s.id <> qid),
g AS (SELECT scale, qid, min(CASE WHEN a.label = b.label AND place <= 10 THEN place END) AS rank FROM c JOIN v a ON a.vec_id = qid JOIN v b ON b.vec_id = c.id GROUP BY scale, qid),
m AS (SELECT scale, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_10, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 6) AS mrr_10 FROM g GROUP BY scale)
SELECT *, round(((SELECT arg_min(accuracy, scale) FROM m) - accuracy) * 100, 4) AS drop FROM m""")
def scale_curve(spark, d):
    """The rank of the first other vector of the same label, for three sizes of the knowledge base."""
    q, v = _vectors(spark, d)
    subsets = S.scale_subsets(v, v.where(F.col("id") % QUERY_STEP == 0), _SCALES, 3)
    found = R.knn_by_scale(q, v, subsets, _SCALES, 11)
    found = found.where("id <> qid").withColumn("rank", F.row_number().over(R.Window.partitionBy("scale", "qid").orderBy("rank"))).where("rank <= 10")
    labels = found.join(q.select("qid", F.col("label").alias("_a")), "qid").join(v.select("id", F.col("label").alias("_b")), "id")
    return E.scale_table(labels.groupBy("scale", "qid").agg(F.min(F.when(F.col("_a") == F.col("_b"), F.col("rank"))).alias("rank")))


@_query("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag || cast(l_partkey AS varchar) AS t FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, a.t AS text, coalesce(string_agg(b.t, '|' ORDER BY b.l_linenumber, b.t), '') AS neighbours
FROM l a LEFT JOIN l b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber <> a.l_linenumber GROUP BY ALL""")
def row_neighbours(spark, d):
    """Each line with the others of its order."""
    cells = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("text")).distinct()
    return M.row_neighbours(cells, ["l_orderkey"], "l_linenumber").withColumn("neighbours", F.array_join("neighbours", "|"))


@_query("""SELECT p_partkey AS row, 'col0: name : ' || p_name || ' | col1: ' || p_brand AS row_text FROM part UNION ALL SELECT -1, 'col0: name'""")
def headed_rows(spark, d):
    """Parts as cells of one table, whose first column has a header."""
    p = _t(spark, d, "part")
    cell = lambda i, c: F.struct(F.lit(i).alias("col"), F.col(c).alias("text"))
    cells = p.select(F.col("p_partkey").alias("row"), F.inline(F.array(cell(0, "p_name"), cell(1, "p_brand"))))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("row"), F.lit(0).alias("col"), F.lit("name").alias("text"))
    cells = cells.unionByName(head).withColumns({"table_id": F.lit("part"), "header": F.lit(None).cast("string"), "pos": F.lit(0)})
    return M.serialize_rows(M.prefix_header(cells)).drop("table_id")


@_query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) BETWEEN 3 AND 6)")
def tables_by_size(spark, d):
    """conversations of 3 to 6 turns."""
    cells = _t(spark, d, "conversations").withColumn("table_id", F.col("conv_id"))
    return M.tables_by_size(cells, 3, 6).select("conv_id", "turn")


@_query("""WITH f AS (SELECT p_brand, p_partkey, p_name, cast(length(p_name) <= 12 AS int) AS s FROM part), b AS (SELECT p_brand, max(s) AS m FROM f GROUP BY p_brand),
r AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY md5('11:' || cast(p_partkey AS varchar)), p_partkey) AS r FROM f JOIN b USING (p_brand) WHERE s = m)
SELECT p_brand, p_partkey, p_name FROM r WHERE r <= 3""")
def picked_cases(spark, d):
    """K5: three parts of each brand, from short names where there are any."""
    return S.pick_cases(_t(spark, d, "part").select("p_brand", "p_partkey", "p_name"), "p_brand", "p_name", "p_partkey", 3, 11, 12)


@_query("SELECT p_partkey, p_name FROM part ORDER BY md5('13:' || cast(p_partkey AS varchar)), p_partkey LIMIT 50")
def subsampled(spark, d):
    """Fifty parts in hash order."""
    return S.subsample(_t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", 50, 13)


_BUCKET_SQL = "CAST('0x' || substr(md5('17:' || cast({0} AS varchar)), 1, 8) AS bigint) % {1}"
_RING_SQL = f"""WITH ring AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY md5('17:' || cast(p_partkey AS varchar)), p_partkey) - 1 AS place, count(*) OVER () AS size FROM part),
a AS (SELECT c_custkey AS pid, c_custkey % 100 AS own, step, ({_BUCKET_SQL.format('c_custkey', '(SELECT max(size) FROM ring)')} + step) % (SELECT max(size) FROM ring) AS place FROM customer, (SELECT unnest([0, 1, 2, 3]) AS step)),
r AS (SELECT pid, own, id, row_number() OVER (PARTITION BY pid ORDER BY step) AS no FROM a JOIN ring USING (place) WHERE id <> own)
"""


def _own_parts(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") % 100).alias("id"))


@_query(_RING_SQL + "SELECT pid, id, cast(no AS int) AS no FROM r WHERE no <= 3")
def negative_pairs(spark, d):
    """For each customer three parts that aren't its own."""
    return S.random_negatives(_own_parts(spark, d), _t(spark, d, "part").select(F.col("p_partkey").alias("id")), 3, 17)


@_query(_RING_SQL + "SELECT pid, id, 0 AS label FROM r WHERE no <= 3 UNION ALL SELECT c_custkey, c_custkey % 100, 1 FROM customer")
def training_pairs(spark, d):
    """Each customer's own part and three others, labelled."""
    return S.build_pairs(_own_parts(spark, d), _t(spark, d, "part").select(F.col("p_partkey").alias("id")), 3, 17)


@_query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT c_custkey % 100 FROM customer) ORDER BY md5('19:' || cast(p_partkey AS varchar)), p_partkey LIMIT 96")
def batch_negatives(spark, d):
    """The first 96 parts in hash order that are no customer's own."""
    return S.batch_negatives(_own_parts(spark, d), _t(spark, d, "part").select(F.col("p_partkey").alias("id")), 96, 19)


@_query(f"""WITH c AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT a.p_partkey, b.p_partkey AS positive FROM (SELECT *, {_BUCKET_SQL.format('p_partkey', 'n')} AS pick FROM c) a JOIN c b ON b.p_brand = a.p_brand AND b.i = a.pick""")
def cluster_positives(spark, d):
    """For each part a part of the same brand."""
    return S.cluster_positive(_t(spark, d, "part"), "p_brand", "p_partkey", 17)


@_query("""WITH c AS (SELECT p_brand, min(p_partkey) AS first, row_number() OVER (ORDER BY p_brand) - 1 AS label FROM part GROUP BY p_brand)
SELECT p_partkey, p_brand AS id, '[COL] title [VAL] ' || p_name || ' [COL] brand [VAL] ' || p_brand AS cell_text, cast(label AS bigint) AS label FROM part JOIN c USING (p_brand)""")
def contrastive_pairs(spark, d):
    """Serialised parts with the place of their brand among the sorted brands."""
    rows = _t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("id"), X.ser_bracket("p_name", "p_brand").alias("cell_text"))
    return M.cluster_labels(rows, "id")


@_query("""WITH s AS (SELECT l_linenumber AS epoch, CASE WHEN l_partkey % 5 = 0 OR l_linenumber = 7 THEN NULL ELSE cast(l_discount AS double) END AS loss FROM lineitem),
a AS (SELECT epoch, count(loss) AS valid, count(*) - count(loss) AS nan, round(avg(loss), 6) AS avg_loss FROM s GROUP BY epoch)
SELECT *, round(cast(nan AS double) / (nan + valid), 6) AS nan_rate, valid = 0 OR cast(nan AS double) / (nan + valid) > 0.5 OR coalesce(avg_loss < 0.05, false) AS failed FROM a""")
def epoch_audit(spark, d):
    """Line numbers as epochs, discounts as losses, some of them not a number."""
    missing = (F.col("l_partkey") % 5 == 0) | (F.col("l_linenumber") == 7)
    return E.audit_epochs(_t(spark, d, "lineitem").select(F.col("l_linenumber").alias("epoch"), F.when(missing, F.lit(float("nan"))).otherwise(F.col("l_discount").cast("double")).alias("loss")))


@_query("""WITH e AS (SELECT o_custkey, o_orderkey AS epoch, cast(o_orderkey % 5 AS double) AS ned, cast(o_orderkey % 3 AS double) AS name, cast(o_totalprice AS double) AS loss FROM orders)
SELECT o_custkey, epoch, ned, name, loss FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ned, name, round(loss, 8), epoch) AS r FROM e) WHERE r = 1""")
def best_runs(spark, d):
    """The order of each customer that is least by three measures, looked at one after another."""
    e = _t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("epoch"), (F.col("o_orderkey") % 5).cast("double").alias("ned"), (F.col("o_orderkey") % 3).cast("double").alias("name"), F.col("o_totalprice").cast("double").alias("loss"))
    return E.best_run(e, "o_custkey")


@_query("""WITH c AS (SELECT event_type, cast(round(value * 4000 / 100.0) AS int) AS cell, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL),
t AS (SELECT event_type, sum(c) AS total FROM c GROUP BY event_type), p AS (SELECT i, i * (cast(100 AS double) / 63) AS x FROM (SELECT unnest(range(0, 64)) AS i)),
z AS (SELECT event_type, i, x, c, (x - cell * (cast(100 AS double) / 4000)) / 2.0 AS z FROM c, p)
SELECT event_type, x, round(sum(c * exp(-z * z / 2) * (0.3989422804014327 / 2.0)) / any_value(total), 6) AS density FROM z JOIN t USING (event_type) WHERE abs(z) < 8 GROUP BY event_type, x""")
def value_density(spark, d):
    """A19 on the values of events."""
    return E.density(_t(spark, d, "events"), "value", "event_type", 64, 0.0, 100.0, 2.0)


@_query("""WITH p AS (SELECT DISTINCT trim(p_type) AS n FROM part WHERE trim(p_type) <> ''),
o AS (SELECT n AS id, n AS name, 'OntologyProperty' AS type, 'Standard > ' || n AS path FROM p
  UNION ALL SELECT 'http://dbpedia.org/ontology/' || n, n, 'OntologyProperty', 'DBpedia > ' || n FROM p
  UNION ALL SELECT 'http://schema.org/' || n, n, 'OntologyProperty', 'Schema.org > ' || n FROM p),
e AS (SELECT id, arg_max(name, pos) AS name FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE p_brand END AS id, p_name AS name, p_partkey AS pos FROM part) GROUP BY id)
SELECT id, name, 'Entity' AS type, 'Custom > ' || name AS path FROM e UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM e)""")
def ontology_kb(spark, d):
    """Part types as properties, overwritten by entities named by brand, or by type for some."""
    p = _t(spark, d, "part")
    named = p.select(F.when(F.col("p_partkey") % 7 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    entities = named.select("id", "name", F.lit("Entity").alias("type"), F.concat(F.lit("Custom > "), "name").alias("path"), "pos")
    return M.build_ontology_kb(p, "p_type", entities)


@_query("""WITH k AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)),
c AS (SELECT l_orderkey, max(i) AS n, string_agg('[' || i || '] part ' || l_partkey, chr(10) ORDER BY i) AS a, string_agg(i || '. part ' || l_partkey, chr(10) ORDER BY i) AS b,
  string_agg(i || '. part ' || l_partkey || ' (ID: ' || l_partkey || ')', chr(10) ORDER BY i) AS c FROM k GROUP BY l_orderkey),
l AS (SELECT o_orderkey, cast(o_orderkey AS varchar) AS cell, o_orderpriority AS ctx, n, a, b, c FROM orders JOIN c ON l_orderkey = o_orderkey)
SELECT o_orderkey, 'Select a record from the following candidates that refers to the same real-world entity as the given record. Answer with the corresponding record number surrounded by "[]" or "[0]" if there is none.' || chr(10) || chr(10) || 'Given entity record: ' || cell || chr(10) || chr(10) || 'Candidate records:' || chr(10) || a AS bracket,
  'Query product: ' || cell || chr(10) || chr(10) || 'Candidates:' || chr(10) || b || chr(10) || chr(10) || 'Which candidate matches?' AS bare,
  'You are an entity matching expert. Given a product mention from a web table, select the most likely matching entity from the candidate list.' || chr(10) || chr(10) || 'Product mention: "' || cell || '"' || chr(10) || 'Row context: "' || ctx || '"' || chr(10) || chr(10) || 'Candidate entities:' || chr(10) || c || chr(10) || chr(10)
  || 'Instructions:' || chr(10) || '- Output ONLY the number (1-' || n || ') of the best matching entity.' || chr(10) || '- If none match, output 0.' || chr(10) || '- Do not explain, just output the number.' AS digits FROM l""")
def selection_prompts(spark, d):
    """Each order as a cell with its parts as candidates, in three styles."""
    c = F.array_sort(F.collect_set("l_partkey"))
    named = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(c, lambda k: F.struct(k.cast("string").alias("id"), F.concat(F.lit("part "), k.cast("string")).alias("name"))).alias("c"))
    rows = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(named, "o_orderkey").withColumn("cell", F.col("o_orderkey").cast("string"))
    return rows.select("o_orderkey", *(X.prompt_select("cell", "c", s, "o_orderpriority").alias(s) for s in X.SELECT_PROMPTS))


@_query("""SELECT p_partkey, 'Do the two product descriptions refer to the same real-world product? Entity 1: ''title: ' || p_name || ' | brand: ' || p_brand || chr(39) || '. Entity 2: ' || chr(39) || trim(p_type) || chr(39) || '.' AS prompt,
  CASE WHEN p_size % 2 = 1 THEN 'Yes' ELSE 'No' END AS answer, 'query: ' || p_name AS query, 'passage: ' || p_type AS passage FROM part""")
def instruction_rows(spark, d):
    """Pairs of a serialised part and its type as instruction rows, and both with a prefix."""
    row = X.sft_row(X.ser_bracket("p_name", "p_brand"), F.col("p_type"), F.col("p_size") % 2)
    return _t(spark, d, "part").select("p_partkey", row["prompt"].alias("prompt"), row["answer"].alias("answer"), X.with_prefix("p_name", "query: ").alias("query"), X.with_prefix("p_type", "passage: ").alias("passage"))


@_query("""SELECT l_linenumber, count(*) AS used, round(avg(cast(l_discount AS double)), 6) AS alpha_row FROM lineitem WHERE l_returnflag <> 'R' AND l_partkey % 4 <> 0 AND l_partkey % 5 <> 0 GROUP BY l_linenumber""")
def gate_rows(spark, d):
    """lines as a gate dump; returned ones are headers, some lack a layer and some half of a pair."""
    own, other = F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    second = F.when(F.col("l_partkey") % 5 == 0, F.array(own)).otherwise(F.array(own, other))
    whole = F.create_map(F.lit("0"), F.array(own, other), F.lit("1"), second)
    dump = _t(spark, d, "lineitem").select("l_linenumber", (F.col("l_returnflag") == "R").alias("is_header"), F.when(F.col("l_partkey") % 4 == 0, F.create_map(F.lit("0"), F.array(own, other))).otherwise(whole).alias("alpha_per_layer"))
    return M.usable_gates(dump, ["0", "1"]).groupBy("l_linenumber").agg(F.count("*").alias("used"), F.round(F.avg(F.col("alpha_per_layer")["1"][0]), 6).alias("alpha_row"))


@_query("""WITH t AS (SELECT o_orderkey, 1 + o_orderkey % 5 AS n FROM orders), c AS (SELECT l_orderkey AS t, l_linenumber - 2 AS r, l_partkey % 4 - 1 AS c FROM lineitem)
SELECT t AS table_id, r AS row, c AS col FROM c JOIN t ON o_orderkey = t WHERE r >= 0 AND c >= 0 AND r < n AND c < 2""")
def cells_in_bounds(spark, d):
    """lines as cells of a table for each order, some beyond its edges."""
    tables = _t(spark, d, "orders").select(F.col("o_orderkey").alias("table_id"), (1 + F.col("o_orderkey") % 5).alias("n_rows"), F.lit(2).alias("n_cols"))
    cells = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 2).alias("row"), (F.col("l_partkey") % 4 - 1).alias("col"))
    return M.in_bounds(cells, tables)


@_query("""WITH c AS (SELECT l_orderkey AS t, cast(l_linenumber - 2 AS bigint) AS r, cast(l_partkey % 3 AS bigint) AS c FROM lineitem),
m AS (SELECT t, r, 'row' AS rel, r AS edge FROM c UNION ALL SELECT t, r, 'column', c FROM c)
SELECT k AS kept, t AS table_id, rel, edge, count(*) AS members FROM m, (SELECT unnest(['row', 'column', 'no headers']) AS k) WHERE rel = k OR (k = 'no headers' AND r <> -1) GROUP BY ALL""")
def kept_relations(spark, d):
    """Sizes of row and column groups under each of the three switches; the first line of an order is its header."""
    cells = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 2).cast("long").alias("row"), (F.col("l_partkey") % 3).cast("long").alias("col"))
    members = M.relations(cells)
    sizes = lambda kept, m: m.groupBy(F.lit(kept).alias("kept"), "table_id", "rel", "edge").agg(F.count("*").alias("members"))
    return sizes("row", M.keep_relation(members, "row")).unionByName(sizes("column", M.keep_relation(members, "column"))).unionByName(sizes("no headers", M.keep_relation(members, headers=False)))
