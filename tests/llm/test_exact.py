"""Texts written to make word hashes collide, and items and documents of one repeated word or line."""

import re
import resource
import time
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from cellweave.llm import decontaminate, kernels, minhash, queries, token_counts  # noqa: E402


def colliding(family, n=4):
    """Pairs of words of 16 letters with one hash under a family without a key: two first lanes whose states differ only
    in bits that two letters can differ in, and second lanes that make up for it."""
    rng = np.random.default_rng(family)
    first = rng.integers(97, 123, (40_000, 8)).astype(np.uint8)
    seed, factor = kernels._SEEDS[family]
    start = kernels.mix(np.uint64(16) * factor ^ seed)
    state = kernels.mix((start ^ first.view("<u8").ravel()) * factor)
    bins = defaultdict(list)
    for i, s in enumerate((state & np.uint64(0xE0E0E0E0E0E0E0E0)).tolist()):
        bins[s].append(i)
    letters = {}
    for x in range(97, 123):
        for y in range(97, 123):
            letters.setdefault(x ^ y, (x, y))
    out = []
    for own in bins.values():
        for i, j in zip(own, own[1:]):
            bits = int(state[i] ^ state[j]).to_bytes(8, "little")
            if all(b in letters for b in bits) and (first[i] != first[j]).any():
                out.append(tuple((first[k].tobytes() + bytes(letters[b][side] for b in bits)).decode() for k, side in ((i, 0), (j, 1))))
        if len(out) >= n:
            break
    for a, b in out:
        h = kernels.Words([a.encode(), b.encode()], family=family).hash
        assert a != b and h[0] == h[1]
    return out


@pytest.mark.parametrize("family", [0, 1])
def test_colliding_words(spark, family):
    pairs = colliding(family)
    assert pairs
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), token_counts.counter(path)
    texts = [f"{a} {b}" for a, b in pairs] + [x for p in pairs for x in p]
    assert own.counts(texts).tolist() == [len(lib.encode(x, add_special_tokens=False).ids) for x in texts]

    fill = [f"w{i}" for i in range(40)]
    one, other = fill[:], fill[:]
    for k, (a, b) in enumerate(pairs[:4] * 3):
        one[3 * k], other[3 * k] = a + "", b + ""
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(other))], "doc_id long, text string")
    sets = [{tuple(x[i : i + 2]) for i in range(len(x) - 1)} for x in (one, other)]
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    assert [r.component_id for r in minhash.near_duplicates(docs, shingle=2).orderBy("doc_id").collect()] == [1, 2]

    item = " ".join(a for a, _ in pairs * 5)
    leak = spark.createDataFrame([(1, " ".join(b for _, b in pairs * 5)), (2, "x " + item)], "doc_id long, text string")
    found = decontaminate.leaks(leak, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.coverage) for r in found] == [(2, 1.0)]


LINE = "this line stands in the text again and again."


@pytest.mark.parametrize("part", ["word ", LINE + " "])
def test_repeated_parts(part):
    """2 KB against 1 MB, as one task does it: no product of equal places."""
    texts = [(part * 40_000)[:2000].encode(), (part * 400_000)[:1_000_000].encode()]
    w = decontaminate._words(texts, b"k")
    item, doc = (kernels.shingles(w.hash[w.bounds[i] : w.bounds[i + 1]], 5).view(np.int64) for i in (0, 1))
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    at = np.flatnonzero(np.isin(doc, item))
    tiles = decontaminate.tile(item, doc[at], at, 5)
    assert sum(n for _, _, n in tiles) >= len(item)
    assert time.time() - began < 30
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_repeated_parts_in_tables(spark):
    items = spark.createDataFrame([(1, "word " * 400), (2, (LINE + " ") * 40), (3, "an item of its own that nobody has")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "word " * 200_000), (2, (LINE + " ") * 20_000), (3, "nothing of the kind here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in decontaminate.leaks(docs, items).collect()) == [(1, 1, 1.0), (2, 2, 1.0)]


def test_a_seed_of_all_items(spark):
    """A line that 3000 items share is part of each of them, and brings no pairs by itself."""
    own = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(3000)]
    items = spark.createDataFrame([(i, f"answer with one letter only please {x}") for i, x in enumerate(own)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"answer with one letter only please d{i}") for i in range(300)] + [(1000, own[5]), (1001, "answer with one letter only please " + own[7])], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == [(1000, 5), (1001, 7)]


@pytest.mark.parametrize("n", [5_000_000])
def test_texts_of_megabytes(spark, n):
    text = " ".join(f"wort{i % 9973} x{i % 7919}" for i in range(n // 14))
    rows = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short one")], "doc_id long, text string")
    assert [r.component_id for r in minhash.near_duplicates(rows).orderBy("doc_id").collect()] == [1, 1, 3]
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert token_counts.count_tokens(rows.where("doc_id = 1"), path).first().n_tokens == want
    items = spark.createDataFrame([(1, " ".join(text.split()[50_000:50_040]))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.leaks(rows, items).collect()) == [1, 2]


def tiles_by_definition(a, b, least):
    """Lengths of greedy tiles of two word lists, from all their matches."""
    at = defaultdict(list)
    for j in range(len(b) - least + 1):
        at[tuple(b[j : j + least])].append(j)
    starts = [(i, j) for i in range(len(a) - least + 1) for j in at.get(tuple(a[i : i + least]), ())]
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (least - 1, 0, 0)
        for i, j in starts:
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append(n)
        ma[i : i + n] = mb[j : j + n] = [True] * n


def test_op6_query_both_ways(spark):
    """Every leak and no other, with its figures."""
    root = "/root/testdata/sf0.001"
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()}
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    holders = defaultdict(set)
    for d, w in docs.items():
        for i in range(len(w)):
            holders[tuple(w[i : i + 5])].add(d)
            if i + 5 > len(w):
                break
    want = {}
    for k, own in items.items():
        if len(own) < 5:
            continue
        for d in {d for i in range(len(own) - 4) for d in holders.get(tuple(own[i : i + 5]), ())}:
            tiles = tiles_by_definition(own, docs[d], 5)
            if sum(tiles) >= 0.5 * len(own):
                want[d, k] = (len(own), len(tiles), max(tiles), sum(tiles))
    got = {(r.doc_id, r.item_id): (r.item_words, r.tiles, r.longest, r.covered) for r in queries.QUERIES["op6_decontamination"](spark, root).collect()}
    assert want and got == want


def test_op3_query_on_a_larger_table(spark):
    root = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{root}/labels.parquet").collect() if r.quality is not None}
    rows = [r for r in queries.QUERIES["op3_quality"](spark, root).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in rows if labels[r.doc_id] == v] for v in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    above = np.mean([[x > y for y in bad] for x in good])
    assert above > 0.9
