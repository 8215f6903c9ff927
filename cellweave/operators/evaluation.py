"""Ranking metrics, pair metrics, thresholds, error buckets and distribution statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_match, normalize_entity_id
from .ranking import running

THRESHOLDS = 200


def gold_ranks(gold: DataFrame, cands: DataFrame, normalise: bool = True, listed: DataFrame | None = None) -> DataFrame:
    """(qid, correct, rank): whether the first candidate is the gold id, and the gold's first rank.

    gold(qid, gold_id), cands(qid, rank, id). A query without candidates predicts NIL. listed(qid)
    names the queries that have a list, be it empty; for the others a correct first place
    counts as rank 1.
    """
    norm = normalize_entity_id if normalise else F.col
    c = cands.select("qid", F.col("rank").alias("_r"), norm("id").alias("_id"))
    g = gold.select("qid", norm("gold_id").alias("_gold"))
    joined = g.join(c, "qid", "left")
    hit = F.col("_id") == F.col("_gold")
    per = joined.groupBy("qid").agg(F.min(F.when(hit, F.col("_r"))).alias("rank"), F.coalesce(F.max(F.when(F.col("_r") == 1, hit)), F.first("_gold") == "nil").alias("correct"))
    per = per.select("qid", F.coalesce("correct", F.lit(False)).alias("correct"), "rank")
    if listed is not None:
        per = per.join(listed.select("qid", F.lit(True).alias("_l")), "qid", "left").select("qid", "correct", F.when(F.col("_l").isNull() & F.col("correct"), 1).otherwise(F.col("rank")).alias("rank"))
    return per


def ranking_metrics(gold: DataFrame, cands: DataFrame, ks: Sequence[int] = (5, 10), cutoff: int = 10, normalise: bool = True, listed: DataFrame | None = None) -> DataFrame:
    """One row: n, accuracy, micro_f1, mrr_10, hit_5, hit_10 (A1, A2, A4). With one label per query micro-F1 is accuracy."""
    r = F.col("rank")
    share = lambda c: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0)), 6)
    hits = [share(r <= k).alias(f"hit_{k}") for k in ks]
    mrr = F.round(F.coalesce(F.avg(F.when(r <= cutoff, 1 / r).otherwise(0.0)), F.lit(0.0)), 6)
    return gold_ranks(gold, cands, normalise, listed).agg(F.count("*").alias("n"), share(F.col("correct")).alias("accuracy"), share(F.col("correct")).alias("micro_f1"), mrr.alias(f"mrr_{cutoff}"), *hits)


def name_metrics(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """One row: name_accuracy and name_micro_f1 over names normalised as ids; 0 without rows (A3)."""
    same = F.round(F.coalesce(F.avg((normalize_entity_id(predicted) == normalize_entity_id(gold)).cast("double")), F.lit(0.0)), 6)
    return df.agg(same.alias("name_accuracy"), same.alias("name_micro_f1"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _prf(label: str, predicted: Column) -> list[Column]:
    y = F.col(label) == 1
    tp, p, n = F.count_if(y & predicted), F.count_if(predicted), F.count_if(y)
    return [F.round(v, 6).alias(k) for k, v in (("precision", _ratio(tp, p)), ("recall", _ratio(tp, n)), ("f1", _ratio(2 * tp, p + n)))]


def prf(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    """One row: precision, recall, f1; a division by zero is 0 (A5)."""
    return df.agg(*_prf(label, predicted))


def threshold_sweep(df: DataFrame, sim: str, label: str) -> DataFrame:
    """(k, threshold, tp, predicted, positives, f1) for thresholds k / 200 from -1 to 1, where sim >= threshold predicts a match.

    A histogram over the 401 thresholds is the only aggregation of the data; the running sums go over its rows.
    """
    s = F.round(F.col(sim), 9)
    k = F.floor(s * THRESHOLDS)
    k = F.when((k + 1) / float(THRESHOLDS) <= s, k + 1).when(k / float(THRESHOLDS) > s, k - 1).otherwise(k)
    k = F.least(F.greatest(k, F.lit(-THRESHOLDS - 1)), F.lit(THRESHOLDS))
    hist = df.groupBy(k.cast("int").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    grid = df.sparkSession.range(-THRESHOLDS - 1, THRESHOLDS + 1).select(F.col("id").cast("int").alias("k"))
    up = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, pos = F.coalesce("n", F.lit(0)), F.coalesce("pos", F.lit(0))
    out = grid.join(hist, "k", "left").select("k", F.sum(pos).over(up).alias("tp"), F.sum(n).over(up).alias("predicted"), F.sum(pos).over(every).alias("positives"))
    f1 = F.round(_ratio(2 * F.col("tp"), F.col("predicted") + F.col("positives")), 6)
    return out.where(F.col("k") >= -THRESHOLDS).select("k", (F.col("k") / float(THRESHOLDS)).alias("threshold"), "tp", "predicted", "positives", f1.alias("f1"))


def best_threshold(df: DataFrame, sim: str, label: str) -> DataFrame:
    """One row: the least threshold of the largest F1, and that F1."""
    sweep = threshold_sweep(df, sim, label).where((F.col("predicted") > 0) | (F.col("positives") == 0))
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", (-F.col("k")).alias("low")))
    return sweep.agg(best.alias("b")).select("b.threshold", "b.f1")


def pair_f1(valid: DataFrame, test: DataFrame, sim: str = "sim", label: str = "label") -> DataFrame:
    """One row: the threshold tuned on valid, its F1 there, and precision, recall and F1 on test."""
    tuned = best_threshold(valid, sim, label).select(F.col("threshold"), F.col("f1").alias("valid_f1"))
    judged = test.crossJoin(F.broadcast(tuned))
    # the tuned row rides along, so that the sweep runs once; without test rows it is null
    return judged.agg(*_prf(label, F.round(F.col(sim), 9) >= F.col("threshold")), F.max("threshold").alias("threshold"), F.max("valid_f1").alias("valid_f1"))


def training_stats(labels: DataFrame, pairs: DataFrame, cluster: str, key: str) -> DataFrame:
    """cluster_stats of pairs, with the number of labels that have no pair as `unmatched`."""
    lost = labels.join(pairs.select(key), key, "left_anti").agg(F.count("*").alias("unmatched"))
    return cluster_stats(pairs, cluster).crossJoin(lost)


def cluster_stats(df: DataFrame, cluster: str) -> DataFrame:
    """One row: pairs, clusters, pairs per cluster."""
    return df.agg(F.count("*").alias("pairs"), F.countDistinct(cluster).alias("clusters"), F.round(_ratio(F.count("*"), F.countDistinct(cluster)), 6).alias("per_cluster"))


def _placed(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, v, c, _upto, _total): distinct values, how often each occurs, and running counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    return running(counts, ["v"], [by], "c", seen=df.select(F.col(value).alias("v")))


def _at(index: Column) -> Column:
    """The value at a place from 0 in sorted order, as an aggregate over _placed."""
    return F.min(F.when(F.col("_upto") > index, F.col("v")))


def latency_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n, mean, median, p95): sorted values s, median s[n // 2], p95 s[int(.95 n)].

    Values are counted first; the picks are made among distinct values by running counts.
    """
    n = F.col("_total")
    picks = [_at(F.floor(n / 2)).alias("median"), _at(F.least(F.floor(n * 95 / 100), n - 1)).alias("p95")]
    return _placed(df, value, by).groupBy(by).agg(F.max(n).alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.max(n), 6).alias("mean"), *picks)


def quantile_stats(df: DataFrame, value: str, by: str, at: Sequence[float] = (0.01, 0.05, 0.5)) -> DataFrame:
    """(by, n, mean, std, p..): population deviation and linearly interpolated quantiles (A17), by running counts of distinct values."""
    names = [f"p{round(q * 100)}" for q in at]
    n = F.col("_total")
    picks = []
    for q, name in zip(at, names, strict=True):
        place = (n - 1) * float(q)
        picks += [_at(F.floor(place)).alias(f"_lo_{name}"), _at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_w_{name}")]
    found = _placed(df, value, by).groupBy(F.col(by).alias("_by")).agg(*picks)
    base = df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))
    joined = base.join(found, F.col(by).eqNullSafe(F.col("_by")), "left")
    between = lambda m: F.round(F.col(f"_lo_{m}") + (F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) * F.col(f"_w_{m}"), 6)
    return joined.select(by, "n", "mean", "std", *(between(m).alias(m) for m in names))


def histogram(df: DataFrame, value: str, by: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(by, bin, n) for every bin of [lo, hi], the last one closed, empty ones with 0."""
    v = F.col(value)
    at = F.least(F.floor((v - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = df.where(v.between(lo, hi)).groupBy(by, at.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.select(by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [by, "bin"], "left").select(by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def ecdf(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, value, ecdf): the share of values up to each distinct value."""
    return _placed(df, value, by).select(by, F.col("v").alias(value), F.round(F.col("_upto") / F.col("_total"), 6).alias("ecdf"))


def class_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n, mean): size and mean of each class of values, to go with their density."""
    return df.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


def density(df: DataFrame, value: str, by: str, grid: int = 1024, lo: float = -1.0, hi: float = 1.0, width: float = 0.02, cells: int = 4000) -> DataFrame:
    """(by, x, density): a Gaussian kernel density on a grid (A19). Values are counted in `cells` cells of [lo, hi]
    first, so the join with the grid is bounded whatever the number of rows."""
    cell = F.round((F.col(value) - lo) * cells / (hi - lo)).cast("int")
    counts = df.where(F.col(value).isNotNull()).groupBy(by, cell.alias("cell")).agg(F.count("*").alias("c"))
    total = counts.groupBy(by).agg(F.sum("c").alias("total"))
    points = df.sparkSession.range(grid).select((F.lit(lo) + F.col("id") * ((hi - lo) / (grid - 1))).alias("x"))
    z = (F.col("x") - (F.lit(lo) + F.col("cell") * ((hi - lo) / cells))) / width
    kernel = F.exp(-z * z / 2) * (0.3989422804014327 / width)
    near = counts.join(F.broadcast(points), F.abs(z) < 8).groupBy(by, "x").agg(F.sum(F.col("c") * kernel).alias("s"))
    return near.join(total, by).select(by, "x", F.round(F.col("s") / F.col("total"), 6).alias("density"))


def error_buckets(a: DataFrame, b: DataFrame, c: DataFrame, key: Sequence[str] = ("qid",)) -> DataFrame:
    """(key.., a, b, c, bucket) of three tables (key.., correct): only_a, all_correct, all_wrong or mixed."""
    key = list(key)
    named = [t.groupBy(*key).agg(F.max("correct").alias(n)) for t, n in ((a, "a"), (b, "b"), (c, "c"))]
    out = named[0].join(named[1], key).join(named[2], key)
    x, y, z = (F.col(n) for n in "abc")
    return out.withColumn("bucket", F.when(x & y & z, "all_correct").when(~x & ~y & ~z, "all_wrong").when(x & ~y & ~z, "only_a").otherwise("mixed"))


def name_cases(first: DataFrame, *others: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key.., gold_name, top1_0, ok_0, top1_1, .., bucket): dumps (key.., pos, gold_name, top1_name) side by side.

    Of rows with one key the last by pos counts, and only keys that all dumps hold. The gold name is
    the first dump's; cases without one are left out. A first place is right if its name matches (P4,
    P5); the buckets are those of error_buckets.
    """
    dumps = [d.groupBy(*key).agg(F.max_by(F.struct("gold_name", "top1_name"), "pos").alias(f"_d{i}")) for i, d in enumerate((first, *others))]
    out = dumps[0]
    for d in dumps[1:]:
        out = out.join(d, list(key))
    out = out.withColumn("gold_name", F.col("_d0.gold_name")).where(F.coalesce(F.col("gold_name") != "", F.lit(False)))
    ok = []
    for i in range(len(dumps)):
        out = out.withColumn(f"top1_{i}", F.col(f"_d{i}.top1_name")).withColumn(f"ok_{i}", name_match(f"top1_{i}", "gold_name"))
        ok.append(F.col(f"ok_{i}"))
    every, none, rest = F.lit(True), F.lit(True), F.lit(True)
    for i, x in enumerate(ok):
        every, none, rest = every & x, none & ~x, rest & ~x if i else rest
    bucket = F.when(every, "all_correct").when(none, "all_wrong").when(ok[0] & rest, "only_a").otherwise("mixed")
    return out.withColumn("bucket", bucket).drop(*(f"_d{i}" for i in range(len(dumps))))


def bucket_counts(joined: DataFrame) -> DataFrame:
    return joined.groupBy("bucket").agg(F.count("*").alias("n"))


def scale_table(ranked: DataFrame, scale: str = "scale") -> DataFrame:
    """(scale, accuracy, hit_5, hit_10, mrr_10, drop) of (scale, rank): drop in points from the first scale."""
    r = F.col("rank")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    out = ranked.groupBy(scale).agg(share(r == 1).alias("accuracy"), share(r <= 5).alias("hit_5"), share(r <= 10).alias("hit_10"), F.round(F.avg(F.when(r <= 10, 1 / r).otherwise(0.0)), 6).alias("mrr_10"))
    first = out.agg(F.min_by("accuracy", scale).alias("_first"))
    return out.crossJoin(F.broadcast(first)).withColumn("drop", F.round((F.col("_first") - F.col("accuracy")) * 100, 4)).drop("_first")


def best_run(epochs: DataFrame, by: str, measures: Sequence[str] = ("ned", "name", "loss"), tolerance: float = 1e-8) -> DataFrame:
    """(by, epoch, measures..): the epoch of each run that is kept when its epochs are looked at in order.

    An epoch replaces the best so far if its first measure is lower by more than the tolerance, or
    within it and the next measure is lower, and so on. So a slow drift within the tolerance replaces
    nothing, and the result depends on the order. measures=("loss",) selects by the loss alone. A null
    or NaN measure is never lower; a run without any number keeps no epoch (null).
    """
    fields = ", ".join(f"{m} double" for m in measures)
    epoch_type = epochs.schema["epoch"].dataType.simpleString()
    start = F.from_json(F.lit("{}"), f"epoch {epoch_type}, {fields}")
    rows = F.array_sort(F.collect_list(F.struct("epoch", *(F.col(m).cast("double").alias(m) for m in measures))))

    def step(best: Column, row: Column) -> Column:
        better, level = F.lit(False), F.lit(True)
        for m in measures:
            b = F.coalesce(best[m], F.lit(float("inf")))
            better = better | (level & F.coalesce(row[m] < b - tolerance, F.lit(False)))
            level = level & F.coalesce(F.abs(row[m] - b) <= tolerance, F.lit(False))
        return F.when(better, row).otherwise(best)

    return epochs.groupBy(by).agg(F.aggregate(rows, start, step).alias("b")).select(by, "b.*")


def audit_epochs(steps: DataFrame) -> DataFrame:
    """(epoch, valid, nan, nan_rate, avg_loss, failed) of steps(epoch, loss)."""
    bad = F.col("loss").isNull() | F.isnan("loss")
    out = steps.groupBy("epoch").agg(F.count_if(~bad).alias("valid"), F.count_if(bad).alias("nan"), F.round(F.avg(F.when(~bad, F.col("loss"))), 6).alias("avg_loss"))
    out = out.withColumn("nan_rate", F.round(_ratio(F.col("nan"), F.col("nan") + F.col("valid")), 6))
    return out.withColumn("failed", (F.col("valid") == 0) | (F.col("nan_rate") > 0.5) | F.coalesce(F.col("avg_loss") < 0.05, F.lit(False)))
