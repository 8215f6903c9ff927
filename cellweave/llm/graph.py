"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, join_hot, materialize


def _star(edges: DataFrame, small: bool, n: int) -> DataFrame:
    """One step of the large-star/small-star scheme; edges hold u > v.

    Large: every neighbour above u is linked with the least of u's neighbourhood.
    Small: u and every neighbour below it are linked with the least of those.
    The minimum is an aggregate with map-side combine, and a hub's edges stay where they are when
    it comes back. n: rows of edges at most.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")
    near = join_hot(both, least, ["u"], "n", n if small else 2 * n)
    if small:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(id, component): the least id that each linked id reaches. Ids without a link get no row.

    links: two long columns a and b; direction, repeated rows and loops don't matter. Null ends
    are no links. The number of rounds grows with the logarithm of the longest path. Each round's
    edges are a table of their own, deleted once the next one is written.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u > v").distinct()
    edges = materialize(edges, name)
    mark = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        grown = materialize(_star(_star(edges, small=False, n=now[0]), small=True, n=2 * now[0]), name)
        discard(edges)
        edges = grown
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
