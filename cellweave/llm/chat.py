"""Chat formatting after cumulative-snapshot collapse, with DataFrame functions only.

Logs hold a conversation again and again as it grows. The prefix hash of a conversation at turn k
adds up one hash for each of its first k turns, each bound to its position; so prefix hashes roll
along a running sum, also across blocks of turns that different tasks hold. A conversation whose
whole hash is the prefix hash of a longer one is a snapshot of it; an anti-join leaves the maximal
ones, of equal ones that with the least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, table

#: Turns of one conversation that one task orders.
BLOCK = 256
#: Fixed parts of the ChatML format.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
KEY = ["k", "a", "b", "c"]


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv, k, a, b, c, last): the prefix hash (a, b, c) after turn k; last: whether that is the whole conversation."""
    said = F.md5(F.concat_ws("\x1f", F.length("role").cast("string"), "role", "text"))
    rows = turns.select("conv", "turn", "role", "text", said.alias("said"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block"))
    # running counts of the blocks give every turn its position
    per = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    at = Window.partitionBy("conv").orderBy("block")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    per = per.select("conv", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("n"))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    placed = rows.join(per, ["conv", "block"]).select("conv", "block", "n", "said", (F.col("before") + F.row_number().over(inside)).alias("k"))
    bound = F.md5(F.concat_ws("|", F.col("k").cast("string"), "said"))
    # 40 bits each: sums of fewer than 2 ** 23 turns stay exact
    pieces = [F.conv(F.substring(bound, i, 10), 16, 10).cast("long").alias(x) for i, x in ((1, "a"), (11, "b"), (21, "c"))]
    placed = placed.select("conv", "block", "n", "k", *pieces)
    running = Window.partitionBy("conv", "block").orderBy("k")
    rolled = materialize(placed.select("conv", "block", "n", "k", *(F.sum(x).over(running).alias(x) for x in "abc")), "chat-prefixes")
    ends = rolled.groupBy("conv", "block").agg(*(F.max_by(x, "k").alias(x) for x in "abc"))
    ends = ends.select("conv", "block", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in "abc"))
    return rolled.join(ends, ["conv", "block"]).select("conv", "k", *((F.col(x) + F.col(f"{x}_before")).alias(x) for x in "abc"), (F.col("k") == F.col("n")).alias("last"))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per maximal conversation: (conv_id, n_turns, n_copies, n_chars, text).

    Turns are ordered by turn, role and text, nulls first; rows that repeat a turn are turns of
    their own. A null role is rendered as `unknown` and a null text as empty, and they equal those.
    Rows without a conv_id belong to no conversation. n_copies counts the conversations that equal
    this one, itself included. A conversation is rendered whole, as one text. An empty table gives
    an empty table; other columns are not read.
    """
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    prefixes = materialize(_prefixes(rows), "chat-hashes")
    whole = prefixes.where("last").groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    maximal = whole.join(prefixes.where("not last").select(*KEY).distinct(), KEY, "left_anti").select("conv", "n_copies")
    shown = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "text", F.lit(CLOSE))
    chats = rows.join(maximal, "conv").groupBy("conv").agg(F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list(F.struct("turn", "role", "text", shown.alias("shown")))).alias("turns"))
    out = chats.select("conv", "n_copies", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("text"))
    return out.select(F.col("conv").alias(conv_id), "n_turns", "n_copies", F.length("text").cast("long").alias("n_chars"), "text")


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n,
         list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role, text) AS l,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text
  FROM t GROUP BY conv_id
), dropped AS (
  SELECT DISTINCT x.conv_id FROM c x JOIN c y ON x.l[1] = y.l[1] AND x.conv_id <> y.conv_id
  WHERE x.n <= y.n AND y.l[1:x.n] = x.l AND (x.n < y.n OR y.conv_id < x.conv_id)
), copies AS (SELECT l, count(*) AS n_copies FROM c GROUP BY l)
SELECT c.conv_id, c.n AS n_turns, copies.n_copies, length(c.text) AS n_chars, c.text
FROM c JOIN copies ON c.l = copies.l WHERE c.conv_id NOT IN (SELECT conv_id FROM dropped)
"""
