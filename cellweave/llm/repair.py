"""Conversation structure repair by Hirschberg's divide and conquer over a grammar of four states.

The roles of a sound conversation read `(s?(ua)+)?` by their initials. Its states: nothing yet,
after the system turn, after a user turn, after an assistant turn. Edits lead from state to state,
and the least cost of all ways between two states of a run of turns is a vector of four numbers: one
from the front, one from the back. They meet in the middle of the run; the crossing with the least
cost, and of several the one whose edits so far come first in ASCII, splits the run into two smaller
ones. So a run takes space in proportion to its length, and no table of back pointers.

Which of two ways of equal cost comes first is known from the front: ways to different states after
the same turns end in an edit that takes a turn, so none is the beginning of another, and the order
of four ways carries over from turn to turn.

Turns are sorted by Spark over ranges of (conversation, turn) and cut into pieces of bounded size. A
conversation that lies within one piece is finished there. Longer ones go on as pieces: each gives
the costs and order of the ways between all states, which are chained for each conversation, and with
the crossings that come out every piece is solved by itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .kernels import small
from .runtime import join_hot, materialize, ship, table, whole_number

#: Costs of edits; those of Keep are 0.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a turn that is put in, or gets another role, by the state before.
_NEXT = (USER, USER, ASSISTANT, USER)
#: The state after a turn that keeps its initial, by (state, initial: s, u, a).
_KEPT = {(NOTHING, 0): SYSTEM, (NOTHING, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
#: What closes a conversation in each state, and its cost.
_CLOSE = ("", "II", "I", "")
_CLOSING = tuple(INSERT * len(x) for x in _CLOSE)
#: A turn is one character: A + 4 * fault + initial (s, u, a, any other).
SOUND, CUT, BLANK, REPEATED = range(4)
_LAWFUL = {(0, 1), (1, 2), (2, 1)}
_FAR = 1 << 60
#: Rows and characters of a piece, rows of a range partition, characters of runs whose edits are remembered.
PIECE_ROWS, PIECE_CHARS, RANGE_ROWS, SHORT = 4096, 4_000_000, 1_000_000, 12
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
OUTPUTS = {**dict.fromkeys(FIGURES, "long"), "audit": "string", "repaired_sha256": "string", "repaired": "string"}


def _ways(code: str) -> list[list[tuple[int, str] | None]]:
    """The cheapest edits, and of these the first in ASCII, that take one turn from state to state."""
    fault, initial = divmod(ord(code) - 65, 4)
    out = [[None] * 4 for _ in range(4)]
    for s in range(4):
        state = s
        for n in range(3):
            edits = [(state, DELETE, "D")]
            if fault in (SOUND, CUT):
                more = TRUNCATED if fault == CUT else 0
                edits.append((_NEXT[state], REROLE + more, "R"))
                if (state, initial) in _KEPT:
                    edits.append((_KEPT[state, initial], more, "K"))
            for t, cost, edit in edits:
                way = (cost + INSERT * n, "I" * n + edit)
                out[s][t] = way if out[s][t] is None else min(out[s][t], way)
            state = _NEXT[state]
    return out


_WAYS = {chr(65 + i): _ways(chr(65 + i)) for i in range(16)}


@lru_cache(1 << 16)
def _onward(costs: tuple, order: tuple, code: str) -> tuple[tuple, tuple, int]:
    """Costs and order of the ways to the four states after one more turn; costs less the least, which comes last."""
    best = [min(((costs[s] + w[0], order[s], w[1]) for s in range(4) if (w := _WAYS[code][s][t]) and costs[s] < _FAR), default=None) for t in range(4)]
    places = sorted(b[1:] for b in best if b)
    least = min(b[0] for b in best if b)
    return tuple(b[0] - least if b else _FAR for b in best), tuple(places.index(b[1:]) if b else 0 for b in best), least


@lru_cache(1 << 16)
def _back(costs: tuple, code: str) -> tuple[tuple, int]:
    """Costs to go from the four states before a turn, given those after it; less the least, which comes last."""
    best = [min((w[0] + costs[t] for t in range(4) if (w := _WAYS[code][s][t])), default=_FAR) for s in range(4)]
    least = min(best)
    return tuple(b - least if b < _FAR else _FAR for b in best), least


def from_front(codes: str, start: int) -> tuple[list[int], tuple]:
    """Least costs of the ways from a state over all turns, by the state they reach, and their order."""
    costs, order, total = tuple(0 if s == start else _FAR for s in range(4)), (0, 0, 0, 0), 0
    for code in codes:
        costs, order, least = _onward(costs, order, code)
        total += least
    return [c + total if c < _FAR else _FAR for c in costs], order


def from_back(codes: str, goal: int | None) -> list[int]:
    """Least costs to go over all turns, by the state before them; goal is the state after them, or None for the end."""
    costs, total = _CLOSING if goal is None else tuple(0 if t == goal else _FAR for t in range(4)), 0
    for code in reversed(codes):
        costs, least = _back(costs, code)
        total += least
    return [c + total if c < _FAR else _FAR for c in costs]


def _solve(codes: str, start: int, goal: int | None) -> str:
    if not codes:
        return _CLOSE[start] if goal is None else ""
    if len(codes) == 1:
        if goal is not None:
            return _WAYS[codes][start][goal][1]
        return min((w[0] + _CLOSING[t], w[1] + _CLOSE[t]) for t in range(4) if (w := _WAYS[codes][start][t]))[1]
    mid = len(codes) // 2
    front, order = from_front(codes[:mid], start)
    back = from_back(codes[mid:], goal)
    _, _, cross = min((front[t] + back[t], order[t], t) for t in range(4) if front[t] < _FAR and back[t] < _FAR)
    return edits(codes[:mid], start, cross) + edits(codes[mid:], cross, goal)


_remembered = lru_cache(1 << 16)(_solve)


def edits(codes: str, start: int = NOTHING, goal: int | None = None) -> str:
    """The initials of the cheapest edits, ASCII-least, from a state over all turns to `goal`, or to the conversation's end."""
    return (_remembered if len(codes) <= SHORT else _solve)(codes, start, goal)


def lines(codes: str, audit: str, roles: list[str], texts: list[str], state: int = NOTHING) -> Iterator[str]:
    """The repaired turns, `role:text`."""
    i = 0
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            yield f"{NAMES[state]}:"
            continue
        if edit == "K":
            state = _KEPT[state, (ord(codes[i]) - 65) % 4]
            yield f"{roles[i]}:{texts[i]}"
        elif edit == "R":
            state = _NEXT[state]
            yield f"{NAMES[state]}:{texts[i]}"
        i += 1


class _Sums:
    """The figures of one conversation, gathered piece by piece."""

    def __init__(self, keep: bool):
        self.counts, self.illegal, self.cost, self.last = [0] * 4, 0, 0, None
        self.low = self.high = None
        self.turns, self.audit, self.digest, self.begun = 0, [], hashlib.sha256(), False
        self.text = [] if keep else None

    def add(self, codes: str, audit: str, state: int, roles: list[str], texts: list[str], low: int | None, high: int | None, turns: int) -> None:
        for c in codes:
            fault, initial = divmod(ord(c) - 65, 4)
            self.counts[fault] += 1
            self.illegal += self.last is not None and (self.last, initial) not in _LAWFUL
            self.last = initial
        taken = audit.replace("I", "")
        self.cost += DELETE * audit.count("D") + INSERT * audit.count("I") + REROLE * audit.count("R")
        self.cost += TRUNCATED * sum(e != "D" and (ord(c) - 65) // 4 == CUT for c, e in zip(codes, taken, strict=True))
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high
        self.audit.append(audit)
        for line in lines(codes, audit, roles, texts, state):
            part = f"\n{line}" if self.begun else line
            self.begun = True
            self.digest.update(part.encode())
            if self.text is not None:
                self.text.append(part)

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {
            "gaps": gaps if gaps < 1 << 63 else None, "blank": self.counts[BLANK], "duplicate": self.counts[REPEATED], "truncated": self.counts[CUT], "illegal": self.illegal,
            "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest(), "repaired": None if self.text is None else "".join(self.text),
        }


def _marked(codes: str, repeated) -> str:
    """codes with these places marked as repeated, but for blank turns."""
    out = list(codes)
    for i in repeated:
        initial = (ord(out[i]) - 65) % 4
        if (ord(out[i]) - 65) // 4 != BLANK:
            out[i] = chr(65 + 4 * REPEATED + initial)
    return "".join(out)


def _turn_code(role: Column, text: Column) -> Column:
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT)
    initial = F.substring(role, 1, 1)
    return F.char(65 + 4 * fault + F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3))


def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """turns (conv_id, turn, role, text, dropped) damaged by crc32 of `conv_id:turn` mod 20.

    0 drops the turn (the row stays, marked), 1 empties its text, 2 removes `[.!?]` from it, 3 repeats
    the row, 4 makes its role user. Nulls count as one space, in the checksum, too. Rows that repeat
    a turn are damaged alike.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.crc32(F.concat(one(conv_id), F.lit(":"), one(turn))) % 20
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"), mark.alias("m"))
    said = F.when(F.col("m").isin(0, 1), "").when(F.col("m") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("m") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (F.col("m") == 0).alias("dropped"), F.explode(F.when(F.col("m") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def _cut(keep: bool, arrow: pa.Schema, most_rows: int, most_chars: int):
    """Sorted turns to pieces; a conversation that begins and ends inside a partition and fits a piece is finished."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        out, held = [], 0

        def piece(whole: bool) -> None:
            nonlocal number, held
            row = {"conv_id": key, "piece": number, "codes": "".join(codes), "low": low, "high": high, "turns": n_turns}
            if whole:
                first, again = set(), []
                for i, said in enumerate(zip(roles, texts)):
                    again.append(i) if said in first else first.add(said)
                sums, marked = _Sums(keep), _marked(row["codes"], again)
                sums.add(marked, edits(marked), NOTHING, roles, texts, low, high, n_turns)
                row |= {"whole": True, **sums.row()}
            else:
                row |= {"whole": False, "roles": roles, "said": texts}
            out.append(row)
            number += 1
            held += sum(map(len, texts)) + 64

        def flush() -> pa.RecordBatch:
            nonlocal held
            batch = pa.RecordBatch.from_pylist(out, arrow)
            out.clear()
            held = 0
            return batch

        begun = False
        inside = False  # the conversation began inside this partition, and no piece of it is out
        for batch in small(batches):
            for k, turn, role, text, code in zip(*(c.to_pylist() for c in batch.columns)):
                new = not begun or k != key
                if new or len(codes) >= most_rows or size >= most_chars:
                    if begun:
                        piece(new and inside)
                    inside = new and begun
                    begun, key = True, k
                    codes, roles, texts, size, low, high, n_turns = [], [], [], 0, None, None, 0
                    if held >= most_chars:
                        yield flush()
                if code is None:
                    continue
                if turn is not None:
                    n_turns += turn != high
                    low, high = turn if low is None else low, turn
                codes.append(code)
                roles.append(role)
                texts.append(text)
                size += len(text)
        if begun:
            piece(False)
        if out:
            yield flush()

    return run


def _between(codes: pd.Series) -> pd.Series:
    """Costs and order of the ways of a piece, by start and end: 32 numbers."""
    out = []
    for c in codes:
        ends = [from_front(c, s) for s in range(4)]
        out.append([x for costs, _ in ends for x in costs] + [x for _, order in ends for x in order])
    return pd.Series(out)


def _crossings(column: pd.Series) -> pd.Series:
    """The states in which the best way enters and leaves each piece of a conversation; none after the last."""
    found = []
    for pieces in column:
        tables = [p["ways"] for p in pieces]
        back = [list(_CLOSING)]
        for w in reversed(tables[1:]):
            back.append([min(w[4 * s + t] + back[-1][t] for t in range(4)) for s in range(4)])
        back.reverse()
        state, rows = NOTHING, []
        for k, (p, w) in enumerate(zip(pieces, tables)):
            start = state
            state = min((w[4 * start + t] + back[k][t], w[16 + 4 * start + t], t) for t in range(4))[2]
            rows.append({"piece": p["piece"], "start": start, "goal": state if k < len(tables) - 1 else None})
        found.append(rows)
    return pd.Series(found)


def _edits(codes: pd.Series, start: pd.Series, goal: pd.Series) -> pd.Series:
    return pd.Series([edits(c, int(s), None if pd.isna(g) else int(g)) for c, s, g in zip(codes, start, goal)])


def _with_repeats(codes: pd.Series, repeated: pd.Series) -> pd.Series:
    return pd.Series([c if r is None else _marked(c, r) for c, r in zip(codes, repeated)])


def _long(pieces: DataFrame, keep: bool, names: list[str], arrow: pa.Schema, schema: T.StructType) -> DataFrame:
    """Results of conversations of several pieces, or at the ends of partitions."""
    between, crossings = F.pandas_udf(_between, "array<long>"), F.pandas_udf(_crossings, "array<struct<piece:long,start:int,goal:int>>")
    solve, mark = F.pandas_udf(_edits, "string"), F.pandas_udf(_with_repeats, "string")
    said = pieces.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", "said")).alias("at", "t"))
    whole = F.concat(F.to_json(F.struct("conv_id")), F.length("t.roles").cast("string"), F.lit(":"), F.col("t.roles"), F.col("t.said"))
    said = materialize(said.select(F.unhex(F.sha2(whole, 256)).alias("digest"), F.struct("piece", "at").alias("place")), "said")
    firsts = materialize(said.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"), "said-first")
    again = join_hot(said, firsts, ["digest"], "n").where("place > first").groupBy("place.piece").agg(F.collect_list("place.at").alias("repeated"))
    coded = pieces.select("conv_id", "piece", "codes").join(again, "piece", "left").select("conv_id", "piece", mark("codes", "repeated").alias("codes"))
    coded = materialize(coded, "turn-codes")
    chains = coded.select("conv_id", F.struct("piece", between("codes").alias("ways")).alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    crossed = materialize(chains.select(F.explode(crossings("p")).alias("c")).select("c.*"), "crossings")
    solved = coded.drop("conv_id").join(crossed, "piece").select("piece", F.col("codes").alias("marked"), "start", solve("codes", "start", "goal").alias("audit"))
    own = pieces.select("conv_id", "piece", "roles", "said", "low", "high", "turns").join(solved, "piece")
    order = own.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    columns = ["conv_id", "marked", "audit", "start", "roles", "said", "low", "high", "turns"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, None
        for batch in small(batches, 8):
            done = []
            for k, *piece in zip(*(batch.column(c).to_pylist() for c in columns)):
                if sums is None or k != key:
                    if sums is not None:
                        done.append({"conv_id": key, **sums.row()})
                    key, sums = k, _Sums(keep)
                sums.add(*piece)
            if done:
                yield pa.RecordBatch.from_pylist(done, arrow)
        if sums is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": key, **sums.row()}], arrow)

    return order.select(*columns).mapInArrow(finish, schema).select(*names)


def repair(turns: DataFrame, outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text, and dropped if some are): conv_id and the outputs asked for.

    gaps: missing numbers between the least and the greatest turn, null turns left out. blank,
    duplicate, truncated: turns by their first fault: no character but white space; role and text
    seen earlier; the last such character not one of `.!?`. illegal: neighbours whose role initials
    are not su, ua or au. cost and audit: the cheapest edits (Keep, Rerole, Delete, Insert) that give
    role initials `(s?(ua)+)?`, ASCII-least. repaired: the turns after them, `role:text`, joined by
    newlines, and its digest repaired_sha256.

    Turns go by number, null ones first; equal numbers go by role and text. Null roles and texts
    count as one space. Conversations with a null id are one conversation. One of which all turns
    are dropped has zeros, an empty audit and an empty text. gaps that don't fit a long are null.
    turn must hold whole numbers, anything else is an error; other columns are not read, and an
    empty table gives an empty table.

    A conversation's digest is a chain over its text; so the last step of a very long one reads its
    pieces one after another in one task, a few at a time in memory.
    """
    spark = turns.sparkSession
    ship(spark)
    whole_number(turns, "turn")
    keep = "repaired" in outputs
    dropped = F.col("dropped") if "dropped" in turns.columns else F.lit(False)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), dropped.alias("dropped"))
    rows = rows.withColumn("code", F.when(~F.col("dropped"), _turn_code(F.col("role"), F.col("text")))).drop("dropped")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / RANGE_ROWS))
    order = ["conv_id", "turn", "role", "text"]
    # equal rows may lie in any order, so they may be dealt to several ranges
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "tie").sortWithinPartitions(*order).drop("tie")
    result = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in OUTPUTS.items())).fields])
    held = T._parse_datatype_string("piece long, whole boolean, codes string, low long, high long, turns long, roles array<string>, said array<string>")
    schema = T.StructType([*result.fields, *held.fields])
    pieces = materialize(ranged.mapInArrow(_cut(keep, to_arrow_schema(schema), PIECE_ROWS, PIECE_CHARS), schema), "conversation-pieces")
    names = ["conv_id", *outputs]
    done = pieces.where("whole").select(*names)
    return done.unionByName(_long(pieces.where("not whole"), keep, names, to_arrow_schema(result), result))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation, its turns damaged: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return repair(damage(table(spark, sf_dir, "conversations")), (*FIGURES, "audit", "repaired_sha256"))
