"""Weighted rendezvous sharding with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, table

#: Parts into which a shard is cut to number its rows without gathering it in one task.
PARTS = 1024


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: the i with the least -ln(u_i) / weight_i, where u_i is a hash of key and i in (0, 1).

    A shard's expected share is its weight's share of all. The value of a shard depends on nothing
    but the key and that shard, so a shard that is added takes rows only into itself, one that is
    removed gives up only its own, and a changed weight moves rows only to or from its shard.
    A null key is a key of its own. Weights must be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit("\0null"))
    values = []
    for i, w in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(i)), 11).cast("double") + 0.5) / float(1 << 53)
        values.append(F.struct((-F.log(u) / float(w)).alias("value"), F.lit(i).alias("shard")))
    return (F.least(*values) if len(values) > 1 else values[0])["shard"]


def number(rows: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", parts: int = PARTS) -> DataFrame:
    """Adds a gapless number from 0 within each shard, in the order of the parts and then of `order`.

    A row's part is a hash of `order` and of its place in the table, so that even one key that
    holds most rows is spread. Only the counts of the parts, at most `parts` for each shard, are
    added up one after the other.
    """
    spread = materialize(rows.withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.pmod(F.xxhash64(*order, "_place"), F.lit(parts)).cast("int")), "shard-parts")
    counts = spread.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy(shard, "_part").orderBy(*order, "_place"))
    return spread.withColumn("_own", own).join(first, [shard, "_part"]).withColumn(slot, (F.col("_first") + F.col("_own") - 1).cast("long")).drop("_place", "_part", "_own", "_first")


def shard(docs: DataFrame, weights: Sequence[float], doc_id: str = "doc_id", text: str = "text", grown: float | None = 1.0) -> DataFrame:
    """One row per row of docs: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    size: UTF-8 bytes of the text plus 1; text_crc32: unsigned CRC-32 of these bytes. A null text
    has no bytes (size 1, CRC 0), as an empty one. grown_shard: the shard when one more, of weight
    `grown`, joins (null if grown is None). Rows that repeat a doc_id share a shard and have slots
    of their own. Other columns are not read. The text itself is not shuffled.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = F.col(doc_id)
    rows = docs.select(
        key.alias("doc_id"),
        (F.length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        (F.lit(None).cast("int") if grown is None else rendezvous(key, [*weights, grown])).alias("grown_shard"),
    )
    return number(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal weight."""
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * 16)
