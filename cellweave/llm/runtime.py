"""Small helpers that all operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows per Arrow batch while an intermediate table is written. Texts may be long, so batches stay short.
ROWS_PER_BATCH = 256
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once in each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).resolve().parent.parent
        target = Path(tempfile.mkdtemp(prefix="spark-ship-"), f"{root.name}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in root.rglob("*.py"):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(str(target))


@contextmanager
def short_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what is run inside; the session's own setting comes back after."""
    own = int(spark.conf.get(_BATCH))
    spark.conf.set(_BATCH, str(rows if own <= 0 else min(own, rows)))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, str(own))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's checkpoint folder.

    Only in local mode, where the session names none (tests), a temporary folder is set; on a
    cluster that is an error, as executors would write to their own disks.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-cellweave-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str, rows: int = ROWS_PER_BATCH) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks that it ran, not what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellweave/{name}-{uuid.uuid4().hex}"
    with short_batches(spark, rows):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote and that nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._table_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a key from which join_hot takes it as hot, at least, and keys that it takes as hot at most.
HOT_ROWS, MOST_HOT = 500, 20_000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], n: str, rows: int | None = None) -> DataFrame:
    """Inner join of left with right, which has one row for each key and in column n how many rows of left it meets.

    Keys with many rows are few, at most MOST_HOT of them, so they are broadcast and their rows stay
    where they are; the others meet in a join whose tasks get a bounded number of rows of a key.
    rows: the number of rows of left, if known.
    """
    total = rows if rows is not None else right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    limit = max(HOT_ROWS, total // MOST_HOT)
    hot = F.broadcast(right.where(F.col(n) > limit).withColumn("_hot", F.lit(True)))
    rest = left.join(hot.select(*on, "_hot"), on, "left").where("_hot is null").drop("_hot")
    return left.join(hot.drop("_hot"), on).unionByName(rest.join(right.where(F.col(n) <= limit), on))


def sample(df: DataFrame, n: int, *by: str) -> DataFrame:
    """At most n rows of df, the first ones by a hash of the columns `by`; only as many hashes, not rows, go through the driver.

    Rows with the hash of the last one are equal in `by`; which of them are taken is open.
    """
    hashed = df.withColumn("_h", F.xxhash64(*by))
    last = hashed.select("_h").orderBy("_h").limit(n).agg(F.max("_h")).first()[0]
    return hashed.where(F.col("_h") <= F.lit(last)).limit(n).drop("_h")


def others(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of df that don't clash with these names, by the session's rule of upper and lower case."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    taken = {n if exact else n.lower() for n in names}
    return [c for c in df.columns if (c if exact else c.lower()) not in taken]


def whole_number(df: DataFrame, *columns: str) -> None:
    """An error, before any work, unless the columns hold whole numbers."""
    for c in columns:
        if not isinstance(df.select(c).schema[0].dataType, T.IntegralType):
            raise ValueError(f"column {c} must hold whole numbers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
