"""Sources and sinks. All schemas are explicit; `pos` is the order of the source.

Files are found and read by Spark alone, so paths may be in any store that it reads.
"""

from __future__ import annotations

import csv
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank, last_segment, strip

KB_FIELDS = ("id", "name", "title", "text", "type", "path")
KB = T.StructType([T.StructField(c, T.StringType()) for c in KB_FIELDS])
_LINK = T.StructType().add("target", T.StructType().add("title", T.StringType()))
_CELL = T.StructType().add("text", T.StringType()).add("surfaceLinks", T.ArrayType(_LINK))
WIKITABLES = T.StructType().add("_id", T.StringType()).add("pgId", T.LongType()).add("tableData", T.ArrayType(T.ArrayType(_CELL)))
#: Rows of a physical table chunk.
CHUNK = 10_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the one that the driver and all executors share, the session's checkpoint folder.

    Only in local mode, where the session names none, a temporary folder takes its place.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-cellweave-")
        spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/cellweave/{name}-{uuid.uuid4().hex}"


def _existing(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """The paths of a list, or of a comma-separated text, that exist in their file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    listed = [p.strip() for p in (paths.split(",") if isinstance(paths, str) else paths) if p.strip()]
    where = [jvm.org.apache.hadoop.fs.Path(p) for p in listed]
    return [p for p, w in zip(listed, where, strict=True) if w.getFileSystem(conf).globStatus(w)]


def numbered(sources: Sequence[DataFrame]) -> DataFrame:
    """The rows of file sources, one after the other, with pos, which ascends in the order of the sources, of their files
    by name, and of the rows of a file. pos is a struct (source, file, block, row) to order by, not a row number."""
    out = None
    for i, df in enumerate(sources):
        # a block of a file is read by one task, in order
        pos = F.struct(F.lit(i).alias("source"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        one = df.select(*df.columns, pos.alias("pos"))
        out = one if out is None else out.unionByName(one)
    return out


def read_kb(spark: SparkSession, paths: str | Sequence[str], max_entities: int | None = None) -> DataFrame:
    """Entities of JSON-lines files (S1, S2, K2), with pos in the order of the list; missing files are skipped, a missing path is an empty text."""
    found = _existing(spark, paths)
    if not found:
        return spark.createDataFrame([], KB).withColumn("pos", F.struct(F.lit(0).alias("source"), F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row")))
    out = numbered([spark.read.schema(KB).json(p) for p in found]).withColumn("path", F.coalesce("path", F.lit("")))
    return out if max_entities is None else out.orderBy("pos").limit(max_entities)


def write_kb(df: DataFrame, path: str) -> None:
    df.select(*(c for c in KB_FIELDS if c in df.columns)).write.mode("overwrite").json(path)


def _fields(spark: SparkSession, path: str, sep: str, least: int) -> tuple[DataFrame, Column]:
    parts = F.split("value", sep)
    return spark.read.text(path).where(F.size(parts) >= least), parts


def read_gt(spark: SparkSession, path: str) -> DataFrame:
    """(table_id, abs_row, col, entity_id) of a headerless CSV; short rows are dropped, ids are last segments (S3, F1).

    Fields may be quoted, a quote in them doubled. Fields beyond the fourth are ignored; a row that
    has more than four of which the fourth is empty counts as short.
    """
    fields = T.StructType([T.StructField(c, T.StringType()) for c in ("table_id", "abs_row", "col", "entity_id", "_bad")])
    df = spark.read.schema(fields).option("columnNameOfCorruptRecord", "_bad").option("escape", '"').csv(path)
    whole = F.col("entity_id").isNotNull() | F.col("_bad").isNull()
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    out = df.where(whole).select(text("table_id").alias("table_id"), strip("abs_row").try_cast("long").alias("abs_row"), strip("col").try_cast("int").alias("col"), last_segment(text("entity_id")).alias("entity_id"))
    return out.where("abs_row is not null and col is not null")


def read_headed_gt(spark: SparkSession, path: str, names: Sequence[Sequence[str]] = (("cell_text", "text", "cell"), ("entity_id", "gold_id", "id"))) -> DataFrame:
    """(text, gold) of a headed CSV: for each, the first of the named columns that isn't blank."""
    df = spark.read.option("header", True).csv(path)
    pick = lambda options: F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in options if c in df.columns), F.lit(None).cast("string"))
    return df.select(pick(names[0]).alias("text"), pick(names[1]).alias("gold")).where("text is not null and gold is not null")


def split_cell_key(key: str = "cell_key") -> list[Column]:
    """table_id, row, col of `tid__row__col`, from the right; null where it isn't one."""
    at = lambda i: F.nullif(F.regexp_extract(key, r"^(.*)__(-?\d+)__(-?\d+)$", i), F.lit(""))
    return [at(1).alias("table_id"), at(2).try_cast("int").alias("row"), at(3).try_cast("int").alias("col")]


def read_wt_gt(spark: SparkSession, path: str) -> DataFrame:
    """(table_id, row, col, zero, title) of quoted CSV with the key as first field; bad rows are dropped."""
    df = spark.read.schema("corpus string, cell_key string, zero int, title string").csv(path, mode="PERMISSIVE")
    return df.select(*split_cell_key(), "zero", "title").where("row is not null and col is not null and title is not null")


def _part(path: Column) -> Column:
    """The number of a table chunk, from its file's name or its folder's: `part_3.csv`, `part=3/`."""
    return F.nullif(F.regexp_extract(path, r"part[_=](\d+)(?!.*part[_=]\d)", 1), F.lit("")).cast("long")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Table chunks below path with abs_row, chunk_idx and row_in_chunk: part number * CHUNK + row of the part.

    A part is a Parquet file or folder, or a CSV file with a header; where both are there, Parquet is
    read. With CSV parts all columns are texts.
    """
    found = []
    parquet, texts = (_existing(spark, [f"{path}/{g}" for g in globs]) for globs in (("*.parquet", "part=*/*.parquet"), ("*.csv",)))
    if parquet:
        df = spark.read.option("basePath", path).parquet(*parquet)
        row, part = F.col("_metadata.row_index"), _part(F.col("_metadata.file_path"))
        found.append(df.select(*(c for c in df.columns if c not in ("abs_row", "part")), part.alias("_part"), row.alias("_row")))
    if texts:
        df = spark.read.option("header", True).csv(texts)
        order = [F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")]
        rows = df.select(*(c for c in df.columns if c not in ("abs_row", "part")), _part(F.col("_metadata.file_path")).alias("_part"), *order)
        # a part has at most CHUNK rows
        rows = rows.withColumn("_row", (F.row_number().over(Window.partitionBy("_part").orderBy("_block", "_id")) - 1).cast("long")).drop("_block", "_id")
        if found:
            own = [F.col(c).cast("string").alias(c) if not c.startswith("_") else F.col(c) for c in found[0].columns]
            rows = rows.join(found[0].select("_part").distinct(), "_part", "left_anti")
            found[0] = found[0].select(*own)
        found.append(rows)
    if not found:
        raise ValueError(f"{path} holds no table chunks")
    df = found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)
    out = df.withColumn("abs_row", F.col("_part") * CHUNK + F.col("_row")).drop("_part", "_row")
    return out.select("*", *row_address())


def row_address(abs_row: str = "abs_row", size: int = CHUNK) -> list[Column]:
    return [F.floor(F.col(abs_row) / size).cast("int").alias("chunk_idx"), (F.col(abs_row) % size).cast("int").alias("row_in_chunk")]


def read_wikitables(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """Nested tables of JSON lines, perhaps gzipped; blank and malformed lines are dropped (S7). parts: spread unsplittable files."""
    df = spark.read.schema(WIKITABLES).option("mode", "DROPMALFORMED").json(path).where("_id is not null")
    return df if parts is None else df.repartition(parts)


def read_pairs(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(left, right, label) of tab-separated lines; short ones are dropped, strict: also those without a whole label."""
    rows, p = _fields(spark, path, "\t", 3)
    out = rows.select(p[0].alias("left"), p[1].alias("right"), strip(p[2]).try_cast("int").alias("label"))
    return out.where("label is not null") if strict else out.withColumn("label", F.coalesce("label", F.lit(0)))


def kb_from_table(df: DataFrame, id_col: str, name_col: str, kind: str = "entity", prefix: str = "") -> DataFrame:
    """Entities of any table's id and name columns; rows with a blank one are dropped."""
    missing = {id_col, name_col} - set(df.columns)
    if missing:
        raise ValueError(f"no column {sorted(missing)}")
    rows = df.where(~blank(F.col(id_col).cast("string")) & ~blank(F.col(name_col).cast("string")))
    return rows.select(F.concat(F.lit(prefix), strip(F.col(id_col).cast("string"))).alias("id"), strip(F.col(name_col).cast("string")).alias("name"), F.lit(kind).alias("type"))


def read_table(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Any CSV, all columns texts."""
    return spark.read.option("header", header).csv(path)


def open_dataset(spark: SparkSession, root: str) -> tuple[str, DataFrame]:
    """`chunks` or `wikitables`, by the files below root, and its labels."""
    if _existing(spark, [f"{root}/tables.jsonl*"]):
        return "wikitables", read_wt_gt(spark, f"{root}/gt.csv")
    if _existing(spark, [f"{root}/gt.csv"]):
        return "chunks", read_gt(spark, f"{root}/gt.csv")
    raise ValueError(f"{root} holds neither kind of data set")


def save_index(df: DataFrame, path: str, vector: str = "vector") -> None:
    """One table of id, vector and, where df has them, name and path: entities and vectors can't get out of step (S13). What was there is replaced."""
    df.select("id", *(c for c in ("name", "path") if c in df.columns), vector).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, vector: str = "vector", count: int | None = None) -> DataFrame:
    """The index, vectors of length 1; an error if its size isn't `count` or its dimensions differ."""
    from ..functions.vectors import l2_normalize

    df = spark.read.parquet(path)
    n, lo, hi = df.agg(F.count("*"), F.min(F.size(vector)), F.max(F.size(vector))).first()
    if (count is not None and n != count) or lo != hi:
        raise ValueError(f"{n} vectors of {lo} to {hi} dimensions")
    return df.withColumn(vector, l2_normalize(vector))


def save_candidates(cands: DataFrame, queries: DataFrame, path: str) -> None:
    """Candidates as a long table; a query without any is a row of its own, without a rank.

    An error if candidates name a query that isn't there.
    """
    if not cands.join(queries, "qid", "left_anti").isEmpty():
        raise ValueError("candidates of unknown queries")
    queries.select("qid").distinct().join(cands, "qid", "left").select(*cands.columns).write.mode("overwrite").parquet(path)


def read_candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored candidates, and all queries (qid) that the table was made for, those with an empty list included."""
    rows = spark.read.parquet(path)
    return rows.where("rank is not null"), rows.select("qid").distinct()


def write_eval_split(gt: DataFrame, cells: DataFrame, stats: DataFrame, path: str) -> None:
    """gt.csv, cells.tsv and prep_stats.json below path."""
    gt.write.mode("overwrite").csv(f"{path}/gt.csv", quoteAll=True)
    cells.write.mode("overwrite").csv(f"{path}/cells.tsv", sep="\t")
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/prep_stats.json")


def append_results(metrics: DataFrame, tag: str, path: str) -> None:
    """A row of metrics, to four decimals, added to a table of results."""
    metrics.select(F.lit(tag).alias("method"), *(F.format_string("%.4f", F.col(c).cast("double")).alias(c) for c in metrics.columns)).write.mode("append").parquet(path)


def _names(spark: SparkSession, glob: str) -> list[str]:
    """The names of the files or folders that a pattern finds."""
    where = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return [f.getPath().getName() for f in found or []]


def convert_chunks(spark: SparkSession, source: str, target: str) -> tuple[list[str], list[str]]:
    """CSV files below source that target doesn't hold yet, as Parquet below target by file name.

    Returns the names that were converted and those that were not, which don't stop the others: files
    without a header line of names that differ and are text, and files with a row that has more or
    fewer fields than the header. One pass reads the headers, one for each different header judges all
    its files together, and one writes the good ones. A file without a row counts as converted once
    it is read, and is read again next time.
    """
    done = {n.removeprefix("file=") for n in _names(spark, f"{target}/file=*")}
    todo = sorted(n for n in _names(spark, f"{source}/*.csv") if n.removesuffix(".csv") not in done)
    if not todo:
        return [], []
    lines = spark.read.option("ignoreCorruptFiles", True).text([f"{source}/{n}" for n in todo])
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))  # the column has it as in a URL
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    heads = lines.select(name.alias("file"), "value", place.alias("at")).groupBy("file").agg(F.min_by("value", "at").alias("header"))
    alike: dict[tuple, list[str]] = {}
    for file, header in heads.collect():  # one row for each file
        names = tuple(n.strip() for n in next(csv.reader([header.lstrip("\ufeff")]), []))
        if names and all(names) and len({n.lower() for n in names}) == len(names) and not set("\0\ufffd") & set(header):
            alike.setdefault(names, []).append(file)
    converted = []
    for names, files in sorted(alike.items()):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, "_bad")])
        read = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_bad").option("columnPruning", False)
        rows = read.csv([f"{source}/{n}" for n in files]).select(name.alias("file"), "*")
        ragged = {r.file for r in rows.groupBy("file").agg(F.count("_bad").alias("bad"), F.count(F.col(f"`{names[0]}`"))).where("bad > 0").collect()}
        good = [n for n in files if n not in ragged]
        if good:
            own = read.csv([f"{source}/{n}" for n in good]).withColumn("file", F.regexp_extract(name, r"^(.*)\.csv$", 1))
            own.drop("_bad").write.mode("append").partitionBy("file").parquet(target)
        converted += good
    return sorted(converted), sorted(set(todo) - set(converted))


def split_rows(df: DataFrame, path: str, n: int = CHUNK) -> None:
    """df(abs_row, ..) in folders `part=i` of rows i * n to i * n + n - 1, in order; read_chunks gives them their abs_row back."""
    parts = df.withColumn("part", F.floor(F.col("abs_row") / n).cast("long"))
    parts.repartition("part").sortWithinPartitions("part", "abs_row").write.mode("overwrite").partitionBy("part").parquet(path)


def write_dump(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def write_normalized(df: DataFrame, source: str, header: bool = True) -> str:
    """A normalised table beside its source: base.normalized.ext."""
    base, dot, ext = source.rpartition(".")
    path = f"{base}.normalized.{ext}" if dot else f"{source}.normalized"
    df.write.mode("overwrite").option("header", header).csv(path)
    return path
