"""The preparation of linked web tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, first_link_title, readable_title, row_text, split_md5_32, split_name, strip


def table_rows(tables: DataFrame) -> DataFrame:
    """(table_id, row, cells) of nested tables(_id, tableData)."""
    return tables.select(F.col("_id").alias("table_id"), F.posexplode("tableData").alias("row", "cells"))


def linked_cells(rows: DataFrame) -> DataFrame:
    """(table_id, row, col, text, title, row_text, split) of the cells with a linked title, of rows(table_id, row, cells)."""
    cells = rows.select("table_id", "row", row_text("cells").alias("row_text"), F.posexplode("cells").alias("col", "cell"))
    out = cells.select("table_id", "row", "col", strip(F.col("cell.text")).alias("text"), first_link_title(F.col("cell.surfaceLinks")).alias("title"), "row_text")
    return out.where(~blank("text") & ~blank("title")).withColumn("split", split_name(split_md5_32("table_id")))


def kb_of_links(cells: DataFrame) -> DataFrame:
    """(id, name, pos): one entity per title, by its first cell."""
    first = cells.groupBy("title").agg(F.min(F.struct("table_id", "row", "col")).alias("pos"))
    return first.select(F.col("title").alias("id"), readable_title("title").alias("name"), "pos")


def prep_stats(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """One row of counters of rows(table_id, row, cells) and their linked cells (A10)."""
    linked = cells.agg(F.count("*").alias("linked_cells"), F.countDistinct("title").alias("entities"), *(F.count_if(F.col("split") == s).alias(s) for s in ("train", "valid", "test")))
    return rows.agg(F.countDistinct("table_id").alias("tables"), F.sum(F.size("cells").cast("long")).alias("cells")).crossJoin(linked)
