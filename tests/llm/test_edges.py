"""Edge rows, adversarial texts and plain recomputations of the corpus operators, and the registered queries themselves."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from cellweave.llm import bpe, decontaminate, embeddings, graph, kernels, language, minhash, quality, queries, runtime, secret_scan, sharding, token_counts  # noqa: E402

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def thue_morse(n, a="q", b="e"):
    x = a
    while len(x) < n:
        x += x.translate(str.maketrans(a + b, b + a))
    return x, x.translate(str.maketrans(a + b, b + a))


def components(ids, linked):
    top = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if b < a and top[a] != top[b] and linked(a, b):
                x, y = sorted((top[a], top[b]))
                top = {k: x if t == y else t for k, t in top.items()}
    return top


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# hashes


@pytest.mark.parametrize("n", [64, 128, 1024, 2048, 4096])
def test_word_hash_of_thue_morse_words(n):
    a, b = (x.encode() for x in thue_morse(n))
    for family in (0, 1):
        assert len(set(kernels.Words([a, b], family=family).hash.tolist())) == 2
    assert kernels.Words([a]).hash[0] != kernels.Words([a], family=1).hash[0]


def test_word_hash_of_all_words_of_a_table(documents):
    for family in (0, 1):
        w = kernels.Words([(t or "").encode() for t in documents.values()], family=family)
        of = {}
        for h, s, e in zip(w.hash.tolist(), w.start.tolist(), w.end.tolist()):
            assert of.setdefault(h, w.data[s:e].tobytes()) == w.data[s:e].tobytes()
        assert len(of) == len({x for x in of.values()})


def test_thue_morse_texts(spark):
    a, b = thue_morse(2048)
    rows = spark.createDataFrame([(1, f"{a} one two"), (2, f"{b} three four"), (3, f"{a} {b} one"), (4, f"{b} {a} one")], "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in minhash.near_duplicates(rows, shingle=1, percent=80).collect() if r.doc_id < 3)
    assert all(r.component_id == r.doc_id for r in minhash.near_duplicates(rows, shingle=2).collect())
    items = spark.createDataFrame([(9, f"{a} {a} {a} one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{b} {b} {b} one two three")], "doc_id long, text string")
    assert decontaminate.leaks(docs, items).count() == 0
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    own = token_counts.counter(path)
    assert own.counts([a, b]).tolist() == [len(lib.encode(x, add_special_tokens=False).ids) for x in (a, b)]


# tokenizers


def code_point_texts():
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x40000 or 0xE0000 <= i < 0xE1000 or i % 997 == 0)]
    return [f"a{chr(i)}b 1{chr(i)} {chr(i)}{chr(i)}c" for i in points]


def test_token_counts_of_every_code_point():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own, texts = Tokenizer.from_file(path), token_counts.counter(path), code_point_texts()
    for at in range(0, len(texts), 10_000):
        part = texts[at : at + 10_000]
        assert own.counts(part).tolist() == [len(e.ids) for e in lib.encode_batch(part, add_special_tokens=False)]


def test_bpe_of_every_code_point():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own, texts = Tokenizer.from_file(path), bpe.encoder(path), code_point_texts()
    for at in range(0, len(texts), 10_000):
        part = texts[at : at + 10_000]
        assert [x.tolist() for x in own.encode(part)[0]] == [e.ids for e in lib.encode_batch(part, add_special_tokens=False)]


def test_bpe_of_random_marks():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own, rng = Tokenizer.from_file(path), bpe.encoder(path), random.Random(2)
    parts = ["a", "E", "Σ", "ς", "é", "é", "̣", "́", "ͅ", "İ", "ß", "\U00011935", "\U00011930", "఼", "ᲀ", "Ᲊ", "Ɤ", " ", "'S", "1", "가", "ᄀ", "ᅡ", "᫁", "࢘", "<|startoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    assert [x.tolist() for x in own.encode(texts)[0]] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


# secrets


def test_secrets_of_a_long_text():
    rng = random.Random(1)
    parts = []
    for _ in range(160_000):
        parts.append("".join(rng.choices("0123456789abcdef", k=20)) if rng.random() < 0.4 else "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/", k=rng.randrange(3, 60))))
    text = " ".join(parts)
    began = time.time()
    found = secret_scan.find(text)
    assert len(text) > 4_000_000 and time.time() - began < 30
    at = text.index(" ", 200_000)
    short = secret_scan.find(text[:at])
    assert [s for s in found if s[2] <= at] == short
    base = [s for s in short if s[1] < 3]
    plain = [(m.start(), 3, m.end()) for m in secret_scan.CANDIDATE.finditer(text[:at]) if secret_scan.suspicious(m[0]) and not any(a < m.end() and m.start() < b for a, _, b in base)]
    assert sorted(base + plain) == short and plain


def test_windows_add_spans(spark):
    rng = random.Random(3)
    key = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    planted = {i: key(40) for i in range(50)}
    rows = [(i, f"the key is {k} and nothing else") for i, k in planted.items()] + [(100 + i, "plain prose with getUserAccountByIdentifier and some-css-class--modifier-2 in it") for i in range(50)]
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), outputs=("spans",)).collect()}
    assert sum(got[i] == "entropy:11:51" for i in planted) >= 49
    assert all(got[100 + i] == "" for i in range(50))


# columns, ids, tables


def test_columns_that_clash_in_case(spark):
    docs = spark.createDataFrame([(1, "a plain text", "x", "y", "z", "w")], "doc_id long, text string, N_Tokens string, SCORE string, Lang_Pred string, Spans string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_counts.count_tokens(docs, path)
    assert out.columns.count("n_tokens") == 1 and "N_Tokens" not in out.columns and out.first().n_tokens == 3
    assert bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=("n_tokens",)).first().n_tokens == 3
    assert secret_scan.scan(docs, outputs=("spans",)).first().spans == ""
    filt = language.learn(docs.withColumn("lang", F.lit("en")))
    assert language.identify(docs, filt).first().lang_pred == "en"
    net = quality.fit(np.zeros((3, quality.FEATURES)), np.ones(3))
    assert 0 < quality.score(docs, np.zeros((quality.SLOTS, quality.DIM), np.float32), net).first().score < 1


def test_ids_that_are_null_or_no_numbers(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (None, 0, None, True)], key=str)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(vectors).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)], key=str)
    sharded = sharding.shard(docs, [1.0] * 4).collect()
    assert len({r.shard for r in sharded if r.doc_id is None}) == 1
    text = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    with pytest.raises(ValueError):
        minhash.near_duplicates(text)
    with pytest.raises(ValueError):
        decontaminate.leaks(text, docs.toDF("item_id", "text"))
    with pytest.raises(ValueError):
        embeddings.near_vectors(vectors.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding"))


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "same words here again"), (1, "same words here again"), (1, "other text"), (2, None)], "doc_id long, text string")
    filt = language.learn(docs.withColumn("lang", F.lit("en")))
    assert language.identify(docs, filt).count() == 4 and language.identify(docs.limit(0), filt).count() == 0
    assert secret_scan.scan(docs).count() == 4 and secret_scan.scan(docs.limit(0)).count() == 0
    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.encode(docs, path).count() == 4 and bpe.encode(docs.limit(0), path).count() == 0
    assert token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 4
    assert [r.n_shingles for r in minhash.near_duplicates(docs, shingle=2).orderBy("n_shingles").collect()] == [0, 1, 3, 3]
    items = docs.toDF("item_id", "text")
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    none = spark.createDataFrame([], "doc_id long, text string, quality int")
    vectors = quality.word_vectors(none)
    net = quality.learn(none, none, vectors)
    assert quality.score(docs, vectors, net).count() == 4 and not vectors.any()


def test_the_session_keeps_its_settings(spark, documents):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    queries.QUERIES["op5_token_counts"](spark, SF).count()
    queries.QUERIES["op8_minhash_dedup"](spark, SF).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_components_of_a_hub(spark):
    rng = random.Random(4)
    hub = 500_000
    edges = [(hub, i) for i in range(3000)] + [(hub + 1, hub), (7, 10_000)] + [(20_000 + i, 20_001 + i) for i in range(30)]
    rng.shuffle(edges)
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(3000), hub, hub + 1, 10_000]) and all(got[20_000 + i] == 20_000 for i in range(31))


def test_hot_join(spark):
    left = spark.range(3000).select((F.col("id") % 3).alias("k"), "id").unionByName(spark.range(5).select((F.col("id") + 10).alias("k"), "id"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k <> 2")
    got = runtime.join_hot(left, right, ["k"], "n")
    assert got.count() == 2005 and got.where("k = 0 and n = 1000").count() == 1000


# embeddings


def test_embeddings_do_not_depend_on_partitions(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    x = rng.standard_normal((1500, 24))
    for i in range(200):
        y = rng.standard_normal(24)
        y -= (y @ x[i]) / (x[i] @ x[i]) * x[i]
        x[700 + i] = 0.92 * x[i] / np.linalg.norm(x[i]) + math.sqrt(1 - 0.92**2) * y / np.linalg.norm(y)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    own = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in (8, 300):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got.append(sorted(map(tuple, embeddings.near_vectors(df.repartition(n)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    assert got[0] == got[1] and sum(r[1] for r in got[0]) >= 400
    assert embeddings.passes_needed(2_000_000, 64, 0.9) > embeddings.passes_needed(50_000, 64, 0.9) > embeddings.passes_needed(100, 64, 0.9)


def test_vectors_of_several_lengths(spark):
    rows = [(i, [1.0, 0.001 * i] + [0.0] * (i % 3)) for i in range(30)] + [(100, [3.0])]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i].component_id == i % 3 and got[i].n_links == 9 for i in range(30)) and got[100].kept


# sharding


def test_rendezvous_recomputed(spark):
    weights = [1.0, 2.5, 1.0]
    rows = spark.range(300).unionByName(spark.createDataFrame([(None,)], "id long")).select("id", sharding.rendezvous(F.col("id"), weights).alias("s")).collect()
    for r in rows:
        text = xxhash.xxh64(("\0null" if r.id is None else str(r.id)).encode(), seed=42).intdigest()
        values = []
        for i, w in enumerate(weights):
            h = xxhash.xxh64(i.to_bytes(4, "little"), seed=text).intdigest()
            values.append((-math.log(((h >> 11) + 0.5) / 2.0**53) / w, i))
        assert r.s == min(values)[1]


# language


def plain_grams(text):
    text = (text or "").lower()
    letters = "".join(c if c.isalpha() else " " for c in text)
    letters = re.sub(" +", " ", letters)
    out = []
    for n in (2, 3):
        for i in range(len(letters) - n + 1):
            g = letters[i : i + n]
            inner = g[1:-1] if n > 2 else ""
            if " " not in inner and g.strip():
                out.append(g)
    return [g for g in out if not (len(g) == 3 and g[1] == " ")]


def test_language_by_plain_sets(spark):
    rng = random.Random(6)
    sound = {"aa": ["ka", "ro", "ti", "mo"], "bb": ["blu", "zen", "ox", "ro"], "cc": ["ñi", "çé", "ua", "ti"]}
    rows = [(i, "".join(rng.choice(sound[lang]) + (" " if rng.random() < 0.4 else "") for _ in range(30)), lang) for i in range(300) for lang in [rng.choice(list(sound))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filt = language.learn(df.where("doc_id < 200"), min_share=1e-3, contrast=4)
    counts = {lang: Counter(g for i, t, x in rows[:200] if x == lang for g in plain_grams(t)) for lang in sound}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    # the contrast holds among the languages that have the n-gram often enough
    own = {lang: {g for g, x in s.items() if x >= 1e-3 and 4 * x >= most[g]} for lang, s in share.items()}
    assert filt.languages == sorted(sound)
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    every = sorted(most)
    bits = filt.languages_of(np.array([pack(g) for g in every], np.int64))[:, 0]
    extra = 0
    for g, b in zip(every, bits.tolist()):
        for k, lang in enumerate(filt.languages):
            assert g not in own[lang] or b >> k & 1  # a filter has no false negatives
            extra += g not in own[lang] and b >> k & 1
    assert extra <= 2
    for i, t, _ in rows[200:]:
        hits = {lang: sum(g in own[lang] for g in plain_grams(t)) for lang in own}
        found = language.identify(df.where(f"doc_id = {i}"), filt).first().lang_pred if i < 203 else filt.predict([t])[0][0]
        assert hits[found] == max(hits.values())


def test_language_query(spark):
    rows = queries.QUERIES["op10_language_id"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    known = [r for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in known) / len(known) >= 0.9


# quality


def test_features_token_by_token():
    rng = random.Random(8)
    texts = ["", "one", *(" ".join(rng.choice(["Alpha", "beta", "x1y2", "Done.", "3,5", "beta", "...", "naïve"]) for _ in range(rng.randrange(1, 40))) for _ in range(20))]
    shape_of = lambda w: "".join("a" if "a" <= chr(b) <= "z" or b >= 128 else "A" if "A" <= chr(b) <= "Z" else "0" if "0" <= chr(b) <= "9" else chr(b) for b in w)
    hashed = lambda b: int(kernels.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    again = int(kernels.mix(np.array([61], np.uint64))[0])
    sums = np.zeros((quality.SLOTS, quality.DIM), np.int64)
    tokens = []
    for t in texts:
        own = []
        before = None
        for w in t.encode().split():
            drawn = re.sub(r"(.)\1+", r"\1", shape_of(w), flags=re.S)
            shape = again if w == before else hashed(drawn.encode("latin-1"))
            own.append((hashed(w) % quality.WORD_SLOTS, quality.WORD_SLOTS + shape % quality.SHAPE_SLOTS))
            before = w
        tokens.append(own)
        for i, (w, s) in enumerate(own):
            near = [x for j in (i - 1, i + 1) if 0 <= j < len(own) for x in own[j]]
            for of, contexts in ((w, [*near, s]), (s, [*near, w])):
                for c in contexts:
                    for k in range(quality.NONZERO):
                        sums[of, quality.INDEX_AT[c, k]] += quality.INDEX_SIGN[c, k]
    got = np.zeros(quality.SLOTS * quality.DIM, np.int64)
    quality._add_contexts(got, *quality.tokens([t.encode() for t in texts]))
    assert (got.reshape(sums.shape) == sums).all()
    vectors = np.random.Generator(np.random.PCG64(1)).standard_normal((quality.SLOTS, quality.DIM)).astype(np.float32)
    x = quality.features([t.encode() for t in texts], vectors)
    for row, own in zip(x, tokens):
        if not own:
            assert not row.any()
            continue
        w, s = (np.stack([vectors[t[k]] for t in own]).astype(float) for k in (0, 1))
        want = np.concatenate([w.mean(0), s.mean(0), s.std(0), [math.log1p(len(own))]])
        assert np.allclose(row, want, atol=2e-3)


def test_network_by_definition():
    rng = np.random.Generator(np.random.PCG64(2))
    x = rng.standard_normal((6000, quality.FEATURES)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    net = quality.fit(x, y)
    z = [sum(math.tanh(sum((float(v) - a) / b * w for v, a, b, w in zip(row, net.shift, net.scale, net.w1[:, h])) + net.b1[h]) * net.w2[h] for h in range(len(net.b1))) + net.b2 for row in x[:5]]
    assert np.allclose(net.score(x[:5]), [1 / (1 + math.exp(-v / net.temperature)) for v in z])
    test = rng.standard_normal((500, quality.FEATURES)).astype(np.float32)
    assert ((net.score(test) > 0.5) == (test[:, 0] + test[:, 1] > 0)).mean() > 0.85


def test_quality_query(spark):
    rows = queries.QUERIES["op3_quality"](spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    known = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, y in known if y], [s for s, y in known if not y]
    assert not good or not bad or np.mean([[a > b for b in bad] for a in good]) > 0.9


# decontamination


def plain_tiles(a, b, least):
    ma, mb, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        covered += n
        ma[i : i + n] = mb[j : j + n] = [True] * n


def test_leaks_by_plain_tiling(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randrange(3, 30))) for _ in range(12)]
    texts = []
    for _ in range(40):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 15)))]
        for item in rng.sample(items, 2):
            w = item.split()
            i = rng.randrange(len(w))
            parts += [" ".join(w[i:]), " ".join(rng.choices(vocabulary, k=3)), " ".join(w[: i + rng.randrange(3)])]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.covered for r in decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            a = item.split()
            covered = plain_tiles(a, t.split(), min(5, len(a)))
            if 2 * covered >= len(a):
                want[d, i] = covered
    assert got == want and want


# registered queries by plain recomputation


def test_token_queries(spark, documents):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.QUERIES["op5_token_counts"](spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        n = len(lib.encode(documents[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((documents[r.doc_id] or "").encode()), n, n > 512)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in queries.QUERIES["op9_bpe"](spark, SF).collect():
        ids = lib.encode(documents[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(want.select(*columns).fetchall())


def test_near_duplicate_query(spark, documents):
    sets = {i: shingle_set(t, 2) for i, t in documents.items()}
    want = components(sorted(documents), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    rows = queries.QUERIES["op8_minhash_dedup"](spark, SF).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in rows)


def test_embedding_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T >= 0.9
    want = components(range(len(rows)), lambda a, b: sims[a, b])
    got = {r.vec_id: r for r in queries.QUERIES["op1_embedding_dedup"](spark, SF).collect()}
    assert [got[r.vec_id].n_links for r in rows] == (sims.sum(1) - 1).tolist()
    assert [got[r.vec_id].component_id for r in rows] == [rows[want[i]].vec_id for i in range(len(rows))]


def test_secret_query(spark, documents):
    for r in queries.QUERIES["op7_secret_scans"](spark, SF).collect():
        t = documents[r.doc_id] or ""
        spans = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in secret_scan.ACCESS.finditer(t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in secret_scan.HEX.finditer(t) if len(m[0]) >= 16]
        assert r.base_sha256 == hashlib.sha256(secret_scan.joined(sorted(spans)).encode()).hexdigest()


def test_sharding_query(spark, documents):
    rows = queries.QUERIES["op2_sharding"](spark, SF).collect()
    assert len(rows) == len(documents) and all(r.law == "key" and r.grown_shard in (r.shard, 16) for r in rows)
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_decontamination_query(spark, documents):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {r.doc_id for r in queries.QUERIES["op6_decontamination"](spark, SF).collect()}
    assert found >= {i for i, t in documents.items() if any(x in (t or "") for x in items)}


# the pipeline's stages


def test_stages_on_edge_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    prose = "the quick brown fox jumps over the lazy dog while seven wizards watch from the tower"
    rows = [(1, prose, "en"), (1, prose, "en"), (2, prose + " again", "en"), (None, prose, "en"), (None, "an entirely different sentence about rivers and mountains far away", None), (3, None, "en"), (4, "", None), (5, "key Zq8Rk2Lw9Tx4Vb7Nm1Pc6Yd3 end of it", "en"), (5, "another text under one id that shares nothing with the others at all", "en")]
    docs = spark.createDataFrame([(i, t, x, "src", len(t or ""), "own", "mine") for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, Score string, redacted string")
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {(r.Score, r.redacted) for r in out.collect()} == {("own", "mine")}, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = Counter((r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert kept[1, prose] == 1 and kept[None, prose] == 0 and kept[2, prose + " again"] == 0
    assert kept[5, rows[7][1]] == kept[5, rows[8][1]] == 1 and kept[3, None] == kept[4, ""] == 1
    assert pipeline.identify_language(spark, docs, SF).where("text is null or text = ''").count() == 0
    shown = {r.text for r in pipeline.redact_secrets(spark, docs, SF).collect()}
    assert "key [ENTROPY] end of it" in shown and None in shown
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    tainted = docs.limit(0).unionByName(spark.createDataFrame([(7, item, "en", "s", 1, "own", "mine"), (7, "clean words under the same number", "en", "s", 1, "own", "mine"), (None, item, "en", "s", 1, "own", "mine")], docs.schema))
    assert [r.text for r in pipeline.drop_contaminated(spark, tainted, SF).collect()] == ["clean words under the same number"]
    assert pipeline.STAGES[4][1](spark, docs, SF).count() == len(rows)
