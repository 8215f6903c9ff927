"""Deterministic sampling: rows are ordered by a hash of a seed and their key, whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import marked_row
from .matching import attach_rows
from .ranking import running


def hash_order(seed: int, *keys: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)))


def hash_bucket(seed: int, key: Column | str, n: Column | int) -> Column:
    """A number from 0 to n - 1 by a hash of seed and key."""
    return F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long") % (F.lit(n) if isinstance(n, int) else n)


def hash_range(seed: int, *keys: Column | str) -> Column:
    """A number from 0 to 4095 that ascends with hash_order; so ranges of about equal size."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 3), 16, 10).cast("int")


def in_hash_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with _no, the place from 0 in hash order, and _total, the number of rows."""
    out = running(df.withColumn("_h", hash_order(seed, key)), ["_h", key], ranges=hash_range(seed, key))
    return out.withColumn("_no", F.col("_upto") - 1).drop("_h", "_upto")


def subsample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n first rows in hash order, sorted by key."""
    return df.orderBy(hash_order(seed, key), key).limit(n).orderBy(key)


def sample_per_group(df: DataFrame, by: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each group by hash order (N9); cut in each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(hash_order(seed, key), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def column_context(rows: DataFrame, by: Sequence[str], pos: str, text: str, max_rows: int, seed: int) -> DataFrame:
    """(by.., context): at most max_rows texts of each column, in row order."""
    return sample_per_group(rows, by, pos, max_rows, seed).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda s: s[text]), " | ").alias("context"))


def marked_context(samples: DataFrame, rows: DataFrame, headers: Sequence[str], max_rows: int, seed: int) -> DataFrame:
    """(chunk_idx, col, context): for each column of a chunk that samples(chunk_idx, col) name, at most max_rows rows
    of rows(chunk_idx, abs_row, cells) by hash, each with the column's cell marked, in row order (R17)."""
    asked = samples.select("chunk_idx", "col").distinct().where((F.col("col") >= 0) & (F.col("col") < len(headers)))
    picked = sample_per_group(rows.join(asked, "chunk_idx"), ["chunk_idx", "col"], "abs_row", max_rows, seed)
    shown = picked.withColumn("_m", marked_row("cells", F.array(*map(F.lit, headers)), F.col("col")))
    return shown.groupBy("chunk_idx", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("abs_row", "_m"))), lambda r: r["_m"]).alias("context"))


def eval_samples(gt: DataFrame, rows: DataFrame, headers: Sequence[str], max_rows: int = 32, seed: int = 42, chunk: int = 10_000) -> DataFrame:
    """gt(.., abs_row, col) with cell_text, row_context, row_with_marker, chunk_idx, row_in_chunk and context, the marked rows
    of its column (R17, J1, W4). Rows and columns that are missing give empty texts and, unless another label names the
    column with a row that is there, an empty context."""
    names = F.array(*map(F.lit, headers))
    wide = rows.select("abs_row", "cells", marked_row("cells", names, F.lit(-1)).alias("row_context"))
    out = attach_rows(gt, wide.withColumn("_marks", F.col("cells"))).withColumn("_in", F.col("_marks").isNotNull() & F.col("col").between(0, len(headers) - 1))
    out = out.withColumn("row_with_marker", F.when(F.col("_in"), marked_row("_marks", names, F.col("col"))).otherwise("")).drop("_marks")
    out = out.withColumn("row_context", F.when(F.col("_in"), F.col("row_context")).otherwise(""))
    out = out.withColumns({"chunk_idx": F.floor(F.col("abs_row") / chunk).cast("int"), "row_in_chunk": (F.col("abs_row") % chunk).cast("int")})
    context = marked_context(out.where("_in"), rows.withColumn("chunk_idx", F.floor(F.col("abs_row") / chunk).cast("int")), headers, max_rows, seed)
    none = F.array().cast("array<string>")
    return out.drop("_in").join(context, ["chunk_idx", "col"], "left").withColumn("context", F.coalesce("context", none))


def scale_subsets(kb: DataFrame, gold: DataFrame, scales: Sequence[int], seed: int) -> DataFrame:
    """(scale, id): for each scale all gold ids in kb and the first others in hash order, n in all; the first n golds if there are more.

    Golds are numbered before the others; a task sorts one range of hashes, never all rows.
    """
    ids = kb.select("id").distinct()
    flagged = ids.join(gold.select("id").distinct().withColumn("_g", F.lit(0)), "id", "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    flagged = flagged.withColumn("_h", hash_order(seed, "id"))
    ranked = running(flagged, ["_g", "_h", "id"], ranges=F.col("_g") * 4096 + hash_range(seed, "id")).where(F.col("_upto") <= max(scales))
    return ranked.withColumn("scale", F.explode(F.array(*map(F.lit, scales)))).where(F.col("_upto") <= F.col("scale")).select("scale", "id")


def hard_negatives(positives: DataFrame, neighbours: DataFrame, kb: DataFrame, n: int, ratio: float, seed: int) -> DataFrame:
    """(rank, id, kind): negatives for a batch of positives(pos_order, id).

    neighbours(id, rank, other): nearest entities of each positive. In the order of positives and
    ranks the first round(n (1 - ratio)) that are neither positive nor taken are `hard`; the rest up
    to n is `random`, in hash order.
    """
    quota = int(round(n * (1 - ratio)))
    own = positives.select("id").distinct()
    seen = positives.join(neighbours, "id").select("pos_order", "rank", F.col("other").alias("id")).join(own, "id", "left_anti").groupBy("id").agg(F.min(F.struct("pos_order", "rank")).alias("_at"))
    hard = seen.orderBy("_at", "id").limit(quota).select("id", F.lit(0).alias("_k"), F.struct(F.col("_at.pos_order").cast("string").alias("a"), F.lit("").alias("b")).alias("_s"), F.col("_at").alias("_at"))
    hard = hard.withColumn("rank", F.row_number().over(Window.orderBy("_at", "id"))).select("rank", "id", F.lit("hard").alias("kind"))
    rest = kb.select("id").distinct().join(own, "id", "left_anti").join(hard.select("id"), "id", "left_anti")
    fill = rest.orderBy(hash_order(seed, "id"), "id").limit(n)
    fill = fill.withColumn("rank", F.row_number().over(Window.orderBy(hash_order(seed, "id"), "id")))
    taken = hard.agg(F.count("*").alias("_n"))
    fill = fill.crossJoin(taken).where(F.col("rank") <= n - F.col("_n")).select((F.col("rank") + F.col("_n")).cast("int").alias("rank"), "id", F.lit("random").alias("kind"))
    return hard.unionByName(fill)


def batch_negatives(positives: DataFrame, kb: DataFrame, n: int, seed: int) -> DataFrame:
    """(id): the first n kb entities in hash order that aren't among positives(id)."""
    return kb.select("id").distinct().join(positives.select("id"), "id", "left_anti").orderBy(hash_order(seed, "id"), "id").limit(n)


def random_negatives(positives: DataFrame, kb: DataFrame, n: int, seed: int) -> DataFrame:
    """(pid, id, no): n negatives of each positive(pid, id), numbered from 1; never its own id.

    The entities stand in a circle in hash order; a positive takes those that follow a place given
    by its own hash. So each gets n of them, all different, or all others if kb has no more; work
    and rows grow with the positives, whatever the size of kb.
    """
    ring = in_hash_order(kb.select("id").distinct(), "id", seed)
    size = ring.agg(F.max("_total").alias("_size"))
    asked = positives.select("pid", F.col("id").alias("_own")).crossJoin(F.broadcast(size))
    asked = asked.withColumn("_step", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_size").cast("int") - 1))))
    asked = asked.withColumn("_no", (hash_bucket(seed, "pid", F.col("_size")) + F.col("_step")) % F.col("_size"))
    found = asked.join(ring.select("id", "_no"), "_no").where(F.col("id") != F.col("_own"))
    w = Window.partitionBy("pid").orderBy("_step")
    return found.withColumn("no", F.row_number().over(w)).where(F.col("no") <= n).select("pid", "id", "no")


def build_pairs(positives: DataFrame, kb: DataFrame, negatives: int, seed: int) -> DataFrame:
    """(pid, id, label): each positive(pid, id) with label 1 and its negatives with label 0."""
    wrong = random_negatives(positives, kb, negatives, seed).select("pid", "id", F.lit(0).alias("label"))
    return positives.select("pid", "id", F.lit(1).alias("label")).unionByName(wrong)


def cluster_positive(pairs: DataFrame, cluster: str, key: str, seed: int) -> DataFrame:
    """(key, positive): a member of the same cluster by hash, perhaps the row itself (N8). key is unique in its cluster."""
    placed = running(pairs.select(key, cluster), [key], [cluster]).withColumn("_i", F.col("_upto") - 1)
    pick = placed.select(key, cluster, hash_bucket(seed, key, F.col("_total")).alias("_i"))
    return pick.join(placed.select(cluster, "_i", F.col(key).alias("positive")), [cluster, "_i"]).select(key, "positive")


def pick_cases(df: DataFrame, by: str, text: str, key: str, k: int, seed: int, max_len: int = 40) -> DataFrame:
    """k cases of each bucket in hash order, from short texts where there are any (K5)."""
    short = (F.length(text) <= max_len).cast("int")
    flagged = df.withColumn("_s", short)
    best = flagged.groupBy(by).agg(F.max("_s").alias("_m"))
    return sample_per_group(flagged.join(best, by).where("_s = _m"), [by], key, k, seed).drop("_s", "_m")
