"""Joins of labels, tables and knowledge bases, and rules of which row wins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, cell_at, expand_property, last_segment, normalize_entity_id, row_text, ser_bracket, ser_bracket_entity, strip
from .ranking import running


def first_by(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """(key, value): the first value that isn't null, by pos."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, pos).alias(value))


def dedupe(df: DataFrame, key: str, pos: str = "pos", keep: str = "first") -> DataFrame:
    """One row per key: the first or the last by pos."""
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(F.col(key).alias("_key")).agg(pick(F.struct(*df.columns), F.col(pos)).alias("_row")).select("_row.*")


def union_kb(*sources: DataFrame, key: str = "id", keep: str = "first") -> DataFrame:
    """Sources one after the other, missing columns null, one row per key (U1). Each has its own pos."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    out = out.withColumn("_at", F.struct("_source", "pos"))
    return dedupe(out, key, "_at", keep).drop("_at", "_source")


def match_entities(labels: DataFrame, kb: DataFrame) -> DataFrame:
    """(lid, pos): the kb entity of labels(lid, label): by the id, its last segment, the lowered id, the lowered last segment.

    kb(id, pos). All four keys of an entity are entered in order, and a later entity takes over a
    key; of a label's keys the first that is entered decides. Unmatched labels get no row.
    """

    def keys(c):
        return F.array(F.col(c), last_segment(c), F.lower(c), F.lower(last_segment(c)))

    entered = kb.select("pos", F.posexplode(keys("id")).alias("no", "key")).groupBy("key").agg(F.max_by("pos", F.struct("pos", "no")).alias("pos"))
    asked = labels.select("lid", F.posexplode(keys("label")).alias("no", "key"))
    return asked.join(entered, "key").groupBy("lid").agg(F.min_by("pos", "no").alias("pos"))


def attach_rows(gt: DataFrame, rows: DataFrame) -> DataFrame:
    """gt(.., abs_row, col) with cell_text and row_context from rows(abs_row, cells, row_context); empty where missing."""
    joined = gt.join(rows, "abs_row", "left")
    return joined.withColumn("cell_text", F.coalesce(F.get("cells", F.col("col")), F.lit(""))).withColumn("row_context", F.coalesce("row_context", F.lit(""))).drop("cells")


def attach_names(df: DataFrame, kb: DataFrame, id_col: str, out: str) -> DataFrame:
    """df with the name of an id, by normalised id, of equal ones the last; the id itself where there is none."""
    names = kb.groupBy(normalize_entity_id("id").alias("_nid")).agg(F.max_by("name", "pos").alias("_name"))
    return df.withColumn("_nid", normalize_entity_id(id_col)).join(names, "_nid", "left").withColumn(out, F.coalesce("_name", F.col(id_col).cast("string"))).drop("_nid", "_name")


def matched_only(gt: DataFrame, kb: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Labels whose id is in kb, and one row with the counts of matched and unmatched ones (F8)."""
    ids = kb.select(on).distinct().withColumn("_in", F.lit(True))
    joined = gt.join(ids, on, "left")
    counts = joined.agg(F.count_if("_in").alias("matched"), F.count_if(F.col("_in").isNull()).alias("unmatched"))
    return joined.where("_in").drop("_in"), counts


def wanted(df: DataFrame, ids: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return df.join(ids, on, "left_semi")


def exclude(df: DataFrame, ids: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return df.join(ids, on, "left_anti")


def drop_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which no column is null or blank (F2)."""
    for c in columns:
        df = df.where(~blank(c))
    return df


def build_cluster_kb(rows: DataFrame, gt: DataFrame, prefix: str = "cluster:") -> DataFrame:
    """(id, name, title, text, type, path): one entity per label, named by its first title (R11). rows(abs_row, title), gt(abs_row, label)."""
    named = first_by(rows.join(gt, "abs_row"), "label", "title", "abs_row")
    return named.select(F.concat(F.lit(prefix), F.col("label")).alias("id"), F.col("title").alias("name"), "title", F.col("title").alias("text"), F.lit("product").alias("type"), F.lit("").alias("path"))


def build_ontology_kb(properties: DataFrame, name: str, *entities: DataFrame) -> DataFrame:
    """(id, name, type, path): the forms of each property named in a column, then entities (id, name, type, path) of
    tables; of equal ids the last source wins, within a source the last by pos, which entities may hold (R12)."""
    forms = properties.select(strip(F.col(name).cast("string")).alias("_name")).where(~blank("_name")).distinct().select(F.inline(expand_property("_name")))
    sources = [s if "pos" in s.columns else s.withColumn("pos", F.lit(0).cast("long")) for s in (forms, *entities)]
    return union_kb(*sources, keep="last").select("id", "name", "type", "path")


def usable_gates(dump: DataFrame, layers: Sequence[str], alpha: str = "alpha_per_layer") -> DataFrame:
    """Rows of a gate dump that aren't headers and hold a pair of weights for every layer (F4). A null is_header is none."""
    pairs = [F.coalesce(F.size(F.try_element_at(alpha, F.lit(k))) == 2, F.lit(False)) for k in layers]
    out = dump.where(~F.coalesce("is_header", F.lit(False)))
    for p in pairs:
        out = out.where(p)
    return out


def in_bounds(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """cells(table_id, row, col, ..) that lie in their table, of tables(table_id, n_rows, n_cols) with one row each."""
    inside = "c.table_id = t.table_id and c.row >= 0 and c.col >= 0 and c.row < t.n_rows and c.col < t.n_cols"
    return cells.alias("c").join(tables.alias("t"), F.expr(inside), "left_semi")


#: The kinds of groups that a cell belongs to, and the column that numbers each.
RELATIONS = {"row": "row", "column": "col"}


def relations(cells: DataFrame) -> DataFrame:
    """cells once for each kind of group: rel (`row` or `column`) and the group's number `edge`."""
    return cells.withColumn("_r", F.explode(F.array(*(F.struct(F.lit(k).alias("rel"), F.col(c).cast("long").alias("edge")) for k, c in RELATIONS.items())))).select(*cells.columns, "_r.rel", "_r.edge")


def keep_relation(members: DataFrame, rel: str | None = None, headers: bool = True) -> DataFrame:
    """Memberships of one relation, or of both; with or without header cells, whose row is -1."""
    if rel is not None:
        if rel not in RELATIONS:
            raise ValueError(f"rel must be one of {sorted(RELATIONS)}")
        members = members.where(F.col("rel") == rel)
    return members if headers else members.where("row <> -1")


def cluster_labels(df: DataFrame, key: str) -> DataFrame:
    """df with `label`: the place of key, from 0, among its distinct values in order."""
    values = running(df.select(key).where(F.col(key).isNotNull()).distinct(), [key])
    return df.join(values.select(key, (F.col("_upto") - 1).alias("label")), key)


def training_cells(labels: DataFrame, rows: DataFrame, kb: DataFrame) -> DataFrame:
    """(lid, id, cell_text, entity_text, label) of labels(lid, abs_row, id).

    Ids and kb(id, name, pos) meet by their last path segments, of equal ones the last entity; labels
    without a row of rows(abs_row, title, brand) or an entity are left out. label: cluster_labels of id.
    """
    named = kb.groupBy(last_segment("id", trim=True).alias("id")).agg(F.max_by("name", "pos").alias("_name"))
    own = labels.withColumn("id", last_segment("id", trim=True))
    out = own.join(rows, "abs_row").join(named, "id")
    return cluster_labels(out.select("lid", "id", ser_bracket("title", "brand").alias("cell_text"), ser_bracket_entity("_name").alias("entity_text")), "id")


def row_neighbours(cells: DataFrame, keys: Sequence[str], pos: str = "col", text: str = "text") -> DataFrame:
    """Each cell with the texts of the other cells of its row, in order (J11); a row of a table is a bounded group."""
    whole = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(pos, text))).alias("_all"))
    return cells.join(whole, list(keys)).withColumn("neighbours", F.transform(F.filter("_all", lambda c: c[pos] != F.col(pos)), lambda c: c[text])).drop("_all")


#: Rows of a table in one part of a stored column.
COLUMN_PART = 4096
#: Mentions of a column that are expanded in one task, on average, where it has more.
MENTIONS_PART = 4096


def column_store(cells: DataFrame) -> DataFrame:
    """(table_id, col, part, cells): the data cells (row, text) of each column once, in parts of COLUMN_PART rows, in order.

    A mention points to its column by table_id and col; so contexts take as much room as the cells,
    however many mentions share a column.
    """
    data = cells.where("row >= 0").withColumn("part", F.floor(F.col("row") / COLUMN_PART).cast("long"))
    return data.groupBy("table_id", "col", "part").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("cells"))


def column_neighbours(mentions: DataFrame, store: DataFrame) -> DataFrame:
    """(table_id, row, col, n_row, n_text): a view of column_store that expands, for each of mentions(table_id, row, col, text),
    the data cells of its column, itself included if it is one; itself alone if there are none (J12).

    What comes out is many times what goes in, so columns are dealt to all shuffle partitions, whatever
    the size of the input, and a column of more than MENTIONS_PART mentions to several.
    """
    column, one = ["table_id", "col"], F.lit(1).cast("long")
    large = mentions.groupBy(*column).agg(F.count("*").alias("_n")).where(F.col("_n") > MENTIONS_PART)
    large = F.broadcast(large.select(*column, F.ceil(F.col("_n") / MENTIONS_PART).alias("_k")))
    dealt = mentions.join(large, column, "left").withColumn("_d", F.pmod(F.xxhash64("row"), F.coalesce("_k", one))).drop("_k")
    copied = store.join(large, column, "left").withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_k", one) - 1))).drop("_k")
    n, key = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*column, "_d"]
    joined = dealt.repartition(n, *key).join(copied.repartition(n, *key), key, "left").select("table_id", "row", "col", "text", F.explode_outer("cells").alias("n"))
    alone = F.col("n").isNull()
    return joined.select("table_id", "row", "col", F.coalesce("n.row", "row").alias("n_row"), F.when(alone, F.col("text")).otherwise(F.col("n.text")).alias("n_text"))


def extract_cells(tables: DataFrame, labels: DataFrame, row_context: bool = False) -> DataFrame:
    """labels(table_id, row, col, ..) of nested tables(_id, tableData) with the cell's text.

    row_context: with the texts of the whole row as well (P28, blank ones kept). Tables without a label
    aren't read further (J7); labels without a table are dropped, cells out of range are empty.
    """
    asked = wanted(tables.withColumnRenamed("_id", "table_id"), labels.select("table_id").distinct(), "table_id")
    joined = labels.join(asked.select("table_id", "tableData"), "table_id")
    out = joined.withColumn("text", cell_at("tableData", "row", "col"))
    if row_context:
        out = out.withColumn("row_context", row_text(F.coalesce(F.get("tableData", F.col("row")), F.expr("filter(flatten(tableData), x -> false)")), skip_blank=False))
    return out.drop("tableData")


def labelled_cells(graphs: DataFrame) -> DataFrame:
    """(table_id, cell, id) of graphs(table_id, labeled_indices, target_ent_ids): the nested ids are flattened and go with the indices in order."""
    flat = F.arrays_zip(F.col("labeled_indices").alias("cell"), F.flatten("target_ent_ids").alias("id"))
    return graphs.select("table_id", F.inline(flat)).toDF("table_id", "cell", "id").where("cell is not null")


def entity_mask(cells: DataFrame, labels: DataFrame, on: Sequence[str] = ("table_id", "row", "col")) -> DataFrame:
    """cells with entity_mask, 1 for those that labels name and 0 for all others."""
    marked = labels.select(*on).distinct().withColumn("_m", F.lit(1))
    return cells.join(marked, list(on), "left").withColumn("entity_mask", F.coalesce("_m", F.lit(0))).drop("_m")


def prefix_header(cells: DataFrame, pos: str = "pos") -> DataFrame:
    """cells(table_id, row, col, text, pos) with `header : text` in data rows; header rows have row -1, and of several headers
    of a column the first by pos counts (P9)."""
    heads = cells.where("row = -1").groupBy("table_id", "col").agg(F.min_by("text", pos).alias("_head"))
    joined = cells.join(heads, ["table_id", "col"], "left")
    return joined.withColumn("text", F.when((F.col("row") != -1) & F.col("_head").isNotNull(), F.concat("_head", F.lit(" : "), "text")).otherwise(F.col("text"))).drop("_head")


def serialize_rows(cells: DataFrame) -> DataFrame:
    """(table_id, row, row_text): `header: text` parts in column order, `col{n}` without a header."""
    part = F.concat(F.coalesce("header", F.concat(F.lit("col"), F.col("col").cast("string"))), F.lit(": "), F.coalesce("text", F.lit("")))
    return cells.groupBy("table_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", part.alias("p")))), lambda c: c["p"]), " | ").alias("row_text"))


#: Parts that a key's partial sums are dealt to before they are added up for good.
TREE = 16


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys.., vector): the element-wise mean.

    Each Arrow batch gives one row of sums and counts for each of its keys; these are added up in two
    steps, so no task gets all rows of a hot key. A place that is null, NaN or beyond the end of a
    vector doesn't count there; null vectors count nowhere, and a key with no other has no row.
    """
    keys = list(keys)
    rows = df.select(*(F.col(k) for k in keys), F.col(vector).cast("array<double>").alias("_v")).where("_v is not null")
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", _sums array<double>, _n array<double>"

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            size = pdf["_v"].map(len).to_numpy()
            x = np.full((len(pdf), size.max(initial=0)), np.nan)
            x[np.arange(x.shape[1]) < size[:, None]] = np.concatenate([np.asarray(v, float) for v in pdf["_v"]])
            own = pdf.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            first = np.unique(own, return_index=True)[1]
            sums, n = np.zeros((len(first), x.shape[1])), np.zeros((len(first), x.shape[1]))
            np.add.at(sums, own, np.nan_to_num(x, nan=0.0))
            np.add.at(n, own, ~np.isnan(x))
            yield pdf[keys].iloc[first].reset_index(drop=True).assign(_sums=list(sums), _n=list(n))

    def added(column: str) -> Column:
        plus = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
        return F.reduce(F.collect_list(column), F.array().cast("array<double>"), plus).alias(column)

    parts = rows.mapInPandas(partial, schema).withColumn("_part", F.pmod(F.xxhash64("_sums"), F.lit(TREE)))
    parts = parts.groupBy(*keys, "_part").agg(added("_sums"), added("_n"))
    total = parts.groupBy(*keys).agg(added("_sums"), added("_n"))
    return total.select(*keys, F.zip_with("_sums", "_n", lambda s, n: F.when(n > 0, s / n)).alias(vector))


def structure_mix(cells: DataFrame, vector: str, gate: float, alpha: float) -> DataFrame:
    """cells(table_id, row, col, vector): (1 - alpha) own + alpha (gate row mean + (1 - gate) column mean)."""
    from ..functions.vectors import mix

    r = mean_vector(cells, ["table_id", "row"], vector).withColumnRenamed(vector, "_row")
    c = mean_vector(cells, ["table_id", "col"], vector).withColumnRenamed(vector, "_col")
    joined = cells.join(r, ["table_id", "row"]).join(c, ["table_id", "col"])
    return joined.withColumn(vector, mix(F.col(vector), mix("_col", "_row", gate), alpha)).drop("_row", "_col")


def tables_by_size(cells: DataFrame, lo: int, hi: int) -> DataFrame:
    """Cells of tables with lo to hi cells."""
    return wanted(cells, cells.groupBy("table_id").agg(F.count("*").alias("n")).where(F.col("n").between(lo, hi)), "table_id")


def above_threshold(df: DataFrame, score: str, least: float = 0.5) -> DataFrame:
    """Rows with a score of `least` or more; a null score is none."""
    return df.where(F.col(score) >= least)


def normalize_table(wide: DataFrame, key: str, columns: Sequence[str], found: DataFrame, replace_with: str = "name") -> DataFrame:
    """wide with each cell replaced by the name or the id that found(cell, id, name) has for it, if that isn't empty (R9):
    melted, joined once, pivoted back. found with `key` and `column` goes by these, too, so by the place of a cell."""
    long = wide.unpivot([key], list(columns), "column", "cell")
    on = [c for c in (key, "column", "cell") if c in found.columns]
    new = found.groupBy(*on).agg(F.min(replace_with).cast("string").alias("_new"))
    named = long.join(new, on, "left").withColumn("cell", F.when(F.coalesce(F.col("_new") != "", F.lit(False)), F.col("_new")).otherwise(F.col("cell")))
    return named.groupBy(key).pivot("column", list(columns)).agg(F.first("cell"))
