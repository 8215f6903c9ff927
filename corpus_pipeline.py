"""A corpus pipeline: five stages over `documents`, each by one operator of cellweave.llm.

Every stage gets the documents that its predecessor kept, reread from Parquet. All but the last
return the columns of documents; the last returns the encoded corpus. Every row is judged by its
own text, also where doc_id is null or repeats; columns that have the name of an operator's output
keep their own values; empty documents give empty stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import bpe, decontaminate, language, minhash, secret_scan
from cellweave.llm.runtime import join_hot, materialize, others, table

#: Rows up to whose number a list of them is broadcast (8 bytes each); a longer one is shuffled.
BROADCAST_ROWS = 100_000
#: A document in which no language reaches this score is rejected, as is one without letters.
LEAST_SCORE = 0.3
#: The number that a stage gives each row of its own.
ROW = "_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW, as a table, so that the numbers stay the same."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows without those that dropped (ROW) names, and without ROW."""
    dropped = materialize(dropped.distinct(), "dropped")
    return rows.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, ROW, "left_anti").drop(ROW)


def _apart(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns that clash with these names renamed, and how they are called now."""
    kept = set(others(docs, names))
    now = {c: c if c in kept else f"_own_{c}" for c in docs.columns}
    return docs.withColumnsRenamed({c: n for c, n in now.items() if c != n}), now


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows with a lang; rejects documents without letters, so null and empty ones, and
    those without a language that leads; a missing lang becomes the predicted one."""
    own, now = _apart(docs, ("lang_pred", "score"))
    judged = language.identify(own, language.learn(docs))
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*(F.col(n).alias(c) for c, n in now.items()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles of similarity 0.8 or more, the row with the least doc_id
    stays, the first one if it repeats; rows without a doc_id come last. Null and empty texts stay."""
    rows = _numbered(docs)
    groups = minhash.near_duplicates(rows.select(ROW, "text"), doc_id=ROW, shingle=5, percent=80).select(ROW, F.col("component_id").alias("group"))
    ranked = materialize(groups.join(rows.select(ROW, "doc_id"), ROW), "near-groups")
    best = ranked.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(ROW).alias("row"))).alias("best"), F.count("*").alias("n")).where("n > 1")
    best = materialize(best.select("group", "n", F.col("best.row").alias("best")), "near-best")
    return _without(rows, join_hot(ranked.select("group", ROW), best, ["group"], "n").where(F.col(ROW) != F.col("best")).select(ROW))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover half of a benchmark item or more go. Null and empty texts stay."""
    rows = _numbered(docs)
    found = decontaminate.leaks(rows.select(ROW, "text"), table(spark, sf_dir, "benchmark"), doc_id=ROW)
    return _without(rows, found.select(F.col("doc_id").alias(ROW)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; all documents stay, null and empty texts as they are."""
    own, now = _apart(docs, ("redacted",))
    scanned = secret_scan.scan(own, outputs=("redacted",)).withColumn("text", F.col("redacted"))
    if "n_chars" in docs.columns:
        scanned = scanned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return scanned.select(*(F.col(n).alias(c) for c, n in now.items()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the digest of the text that they decode to; null counts as empty."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, outputs=("n_tokens", "ids", "decoded_sha256")).drop("text")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express the learned and the approximate stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
