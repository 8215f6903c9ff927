"""Conversation repair against a plain recomputation: Dijkstra over (turn, state) that carries whole edit strings."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cellweave.llm import queries, repair

SF = "/root/testdata/sf0.001"
WHITE = re.compile(r"[^\x20\x09-\x0D]")


def broken(rows):
    out = {}
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        m = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        own = out.setdefault(conv, [])
        if m == 1:
            text = ""
        if m == 2:
            text = re.sub(r"[.!?]", "", text)
        if m == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    return out


def accepted(roles):
    return re.fullmatch(r"(s?(ua)+)?", roles) is not None


def cheapest(turns):
    """turns: (initial, must go, truncated). Dijkstra over (cost, audit); the role string so far by its grammar state."""
    n, seen = len(turns), set()
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, i, state, made = heapq.heappop(queue)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == n and state in ("", "a"):
            return cost, audit, made
        push = lambda c, e, j, s, m: heapq.heappush(queue, (cost + c, audit + e, j, s, (*made, m)))
        for x in "ua":
            if x in step[state]:
                push(3, "I", i, x, ("I", x, i))
        if i < n:
            initial, must, cut = turns[i]
            push(4, "D", i + 1, state, ("D", "", i))
            if not must:
                if initial in step[state]:
                    push(3 * cut, "K", i + 1, initial, ("K", initial, i))
                for x in "ua":
                    if x in step[state]:
                        push(3 + 3 * cut, "R", i + 1, x, ("R", x, i))


def plain(rows):
    found = {}
    for conv, own in broken(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        numbers = [t for t, _, _ in own if t is not None]
        counts, coded, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
        for _, role, text in own:
            marks = WHITE.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, made = cheapest(coded)
        name = {"u": "user", "a": "assistant"}
        lines = [f"{name[x]}:" if e == "I" else f"{own[i][1]}:{own[i][2]}" if e == "K" else f"{name[x]}:{own[i][2]}" for e, x, i in made if e != "D"]
        assert accepted("".join(x[0] for x in lines))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:]))
        found[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


FIELDS = [*repair.FIGURES, "audit", "repaired_sha256"]


def run(df):
    rows = repair.repair(repair.damage(df)).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    assert all(hashlib.sha256(r.repaired.encode()).hexdigest() == r.repaired_sha256 for r in rows)
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in rows}


def crowd(seed, conversations, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["one.", "two", "three!", "four? \n", "", "  \t", "five…", None, "six. .", "été"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(most)):
            rows.append((c, rng.choice([t, t, t, t, None, rng.randrange(50)]), rng.choices(roles, [8, 8, 3, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.5 else f"turn {t}." * rng.randrange(1, 3)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_edits_against_dijkstra():
    rng = random.Random(3)
    for _ in range(4000):
        codes = "".join(chr(65 + rng.randrange(16)) for _ in range(rng.randrange(14)))
        turns = [("sua?"[(ord(c) - 65) % 4], (ord(c) - 65) // 4 in (2, 3), (ord(c) - 65) // 4 == 1) for c in codes]
        assert repair.edits(codes) == cheapest(turns)[1]
        assert repair.from_back(codes, None)[0] == cheapest(turns)[0]


def test_conversations(spark):
    rows = crowd(1, 300, 14)
    assert run(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_pieces(spark, monkeypatch):
    """Small pieces, so that conversations are cut, within and between partitions."""
    rows = crowd(2, 60, 40) + [(1000, t, "user" if t % 2 else "assistant", "again." if t % 3 else f"t{t}") for t in range(300)]
    want = plain(rows)
    for size in (1, 7):
        monkeypatch.setattr(repair, "PIECE_ROWS", size)
        assert run(spark.createDataFrame(rows, SCHEMA)) == want


def test_edges(spark):
    odd = [(None, None, None, None), (None, 1, "user", "a."), (7, 3, "user", "long " * 400_000 + "."), (7, 3, "user", "long " * 400_000 + "."), (8, None, "system", "x.")]
    gone = next(c for c in range(100, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    odd.append((gone, 0, "user", "hi."))
    df = spark.createDataFrame(odd, SCHEMA).withColumns({"Audit": F.lit("x"), "cost": F.lit(1), "piece": F.lit(2)})
    got = run(df)
    assert got == plain(odd)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark.createDataFrame([], SCHEMA)) == {}
    with pytest.raises(ValueError):
        repair.repair(spark.createDataFrame([(1, "a", "user", "x")], "conv_id long, turn string, role string, text string"))
    words = spark.createDataFrame([("a", 1, "user", "x."), ("a", 2, "assistant", "y.")], "conv_id string, turn int, role string, text string")
    assert [(r.conv_id, r.audit, r.repaired) for r in repair.repair(words).collect()] == [("a", "KK", "user:x.\nassistant:y.")]


def test_one_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if t % 7 else "same words") for t in range(20_000)] + crowd(5, 50, 8)
    got, want = run(spark.createDataFrame(rows, SCHEMA).repartition(4)), plain(rows)
    # both tables number conversations from 0, so conversation 1 also holds a few of the small one's turns
    assert got == want


def test_registered_query(spark):
    want = plain([tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    got = queries.QUERIES["op13_conversation_repair"](spark, SF)
    assert got.columns == ["conv_id", *FIELDS]
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == want
