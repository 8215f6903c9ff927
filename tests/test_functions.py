"""Hand-made edge rows of the text functions."""

import pytest
from pyspark.sql import functions as F

from cellweave.functions import text as X
from cellweave.functions import vectors as V
from cellweave.operators import evaluation as E
from cellweave.operators import matching as M
from cellweave.operators import sampling as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, expected",
    [(None, "nil"), ("", "nil"), (" NIL ", "nil"), ("None", "nil"), (" 00123 ", "00123"), ("wiki:New%20York_(city)", "new york"), ("http://dbpedia.org/ontology/Category:Foo_Bar", "foo bar"), ("A+B", "a+b"), ("wiki:100%", "100%"), ("(x)", ""), ("a  _ b", "a b")],
)
def test_normalize_entity_id(spark, given, expected):
    assert one(spark, X.normalize_entity_id(F.lit(given).cast("string"))) == expected


def test_names(spark):
    assert one(spark, X.normalize_name(F.lit("Foo-Bar"))) == "foo bar"
    assert one(spark, X.normalize_name(F.lit("abc!"))) == "abc "
    assert not one(spark, X.name_match(F.lit("abc!"), F.lit("abc")))
    assert not one(spark, X.name_match(F.lit(None).cast("string"), F.lit("")))


def test_tokenize(spark):
    assert one(spark, X.tokenize(F.lit("Éléphant naïve_x 12 – ça!"))) == ["éléphant", "naïve_x", "12", "ça"]


def test_serialisers(spark):
    assert one(spark, X.ser_ditto(F.lit("Foo"), F.lit("nan"))) == "COL title VAL Foo"
    assert one(spark, X.ser_ditto(F.lit(""), F.lit(None).cast("string"))) == "COL title VAL"
    assert one(spark, X.ser_bracket(F.lit("Foo"), F.lit(""))) == "[COL] title [VAL] Foo [COL] brand [VAL]"
    assert one(spark, X.strip_colval(F.lit("[COL] title [VAL] Foo bar [COL] brand [VAL] B"))) == "title: Foo bar | brand: B"
    assert one(spark, X.strip_colval(F.lit("COL title VAL Foo"))) == "COL title VAL Foo"
    assert one(spark, X.strip_colval(F.lit("  x "))) == "x"


@pytest.mark.parametrize("context, cell, expected", [("title: A: B | brand: C", "", ("A: B", "C")), ("title: A | brand: None", "", ("A", "None")), ("price: 3", "Z", ("Z", ""))])
def test_parse_row_context(spark, context, cell, expected):
    assert tuple(one(spark, X.parse_row_context(F.lit(context), F.lit(cell)))) == expected


def test_paths(spark):
    assert one(spark, X.path_segments(F.lit(""))) == ["Unknown"]
    assert one(spark, X.path_depth(F.lit("A > B > C"))) == 2
    assert one(spark, X.path_depth(F.lit(" > ".join("abcdefghijkl")))) == 9


@pytest.mark.parametrize("reply, bracket, bare, digits", [("[3]", 3, 3, 3), ("[0]", None, None, None), ("[11]", None, None, None), ("Answer 2, then [4]", 4, 2, 2), ("none", None, None, None)])
def test_parse_reply(spark, reply, bracket, bare, digits):
    assert [one(spark, X.parse_reply(F.lit(reply), 10, s)) for s in ("bracket", "bare", "digits")] == [bracket, bare, digits]


def test_vectors(spark):
    assert one(spark, V.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) == 1.0
    assert sum(one(spark, V.softmax(F.array(F.lit(1.0), F.lit(3.0))))) == pytest.approx(1)


def test_ranking_metrics(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "qid long, gold_id string")
    cands = [(1, 1, "a")] + [(2, r, "b" if r == 7 else f"x{r}") for r in range(1, 9)] + [(3, 1, "z"), (4, 1, "d")]
    listed = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    row = E.ranking_metrics(gold, spark.createDataFrame(cands, "qid long, rank int, id string"), listed=listed).first()
    assert (row.accuracy, row.hit_5, row.hit_10) == (0.5, 0.5, 0.75)
    assert row.mrr_10 == pytest.approx((1 + 1 / 7 + 0 + 1) / 4, abs=1e-6)


def test_best_threshold(spark):
    df = spark.createDataFrame([(0.90, 1), (0.80, 1), (0.40, 0)], "sim double, label int")
    assert tuple(E.best_threshold(df, "sim", "label").first()) == (0.405, 1.0)


def test_latency(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)], "k string, v double")
    row = E.latency_summary(df, "v", "k").first()
    assert (row["mean"], row["median"], row["p95"]) == (5.5, 6.0, 10.0)


def test_four_keys(spark):
    kb = spark.createDataFrame([("http://x/Foo", 0), ("foo", 1)], "id string, pos long")
    labels = spark.createDataFrame(list(enumerate(["Foo", "FOO", "http://y/foo", "bar"])), "lid long, label string")
    assert {r.lid: r.pos for r in M.match_entities(labels, kb).collect()} == {0: 0, 1: 1, 2: 1}


def test_quota(spark):
    pos = spark.createDataFrame([(0, 1000)], "pos_order long, id long")
    near = spark.createDataFrame([(1000, r, r) for r in range(1, 6)], "id long, rank int, other long")
    got = S.hard_negatives(pos, near, spark.range(50), 10, 0.75, 1).collect()
    assert [r.kind for r in sorted(got, key=lambda r: r["rank"])] == ["hard"] * 2 + ["random"] * 8 and len({r.id for r in got}) == 10


def test_prompts(spark):
    named = F.array(F.struct(F.lit("7").alias("id"), F.lit("Foo").alias("name")), F.struct(F.lit("8").alias("id"), F.lit("Bar").alias("name")))
    assert one(spark, X.prompt_select(F.lit("x"), named)).endswith('if there is none.\n\nGiven entity record: x\n\nCandidate records:\n[1] Foo\n[2] Bar')
    assert one(spark, X.prompt_select(F.lit("x"), named, "bare")) == "Query product: x\n\nCandidates:\n1. Foo\n2. Bar\n\nWhich candidate matches?"
    shown = one(spark, X.prompt_select(F.lit(None).cast("string"), named, "digits", F.lit("a: b")))
    assert 'Product mention: ""\nRow context: "a: b"\n\nCandidate entities:\n1. Foo (ID: 7)\n2. Bar (ID: 8)\n\n' in shown and "(1-2)" in shown
    assert one(spark, X.prompt_pair(F.lit("[COL] title [VAL] A [COL] brand [VAL] B"), F.lit(" C "))) == "Do the two product descriptions refer to the same real-world product? Entity 1: 'title: A | brand: B'. Entity 2: 'C'."
    assert one(spark, X.with_prefix(F.lit("a"), "query: ")) == "query: a"


def test_property_forms(spark):
    assert [tuple(r) for r in one(spark, X.expand_property(F.lit("size")))] == [("size", "size", "OntologyProperty", "Standard > size"), ("http://dbpedia.org/ontology/size", "size", "OntologyProperty", "DBpedia > size"), ("http://schema.org/size", "size", "OntologyProperty", "Schema.org > size")]


def test_structure_filters(spark):
    dump = spark.createDataFrame([(1, None, {"0": [0.1, 0.9], "1": [0.2, 0.8]}), (2, True, {"0": [0.1, 0.9], "1": [0.2, 0.8]}), (3, False, {"0": [0.1, 0.9]}), (4, False, {"0": [0.1, 0.9], "1": [0.2]}), (5, False, None)], "id int, is_header boolean, alpha_per_layer map<string,array<double>>")
    assert [r.id for r in M.usable_gates(dump, ["0", "1"]).collect()] == [1]
    cells = spark.createDataFrame([("t", 0, 0), ("t", -1, 0), ("t", 2, 0), ("t", 1, 1), ("u", 0, 0), ("t", None, 0)], "table_id string, row int, col int")
    assert sorted((r.row, r.col) for r in M.in_bounds(cells, spark.createDataFrame([("t", 2, 2)], "table_id string, n_rows int, n_cols int")).collect()) == [(0, 0), (1, 1)]
    members = M.relations(cells.where("row is not null"))
    assert members.count() == 10 and M.keep_relation(members, "row").count() == 5 and M.keep_relation(members, headers=False).count() == 8
    with pytest.raises(ValueError):
        M.keep_relation(members, "diagonal")
    kb = M.build_ontology_kb(spark.createDataFrame([("a",), ("a",), (" ",), (None,)], "p string"), "p", spark.createDataFrame([("a", "Own", "Entity", "Custom > Own")], "id string, name string, type string, path string"))
    assert sorted((r.id, r.name) for r in kb.collect()) == [("a", "Own"), ("http://dbpedia.org/ontology/a", "a"), ("http://schema.org/a", "a")]
