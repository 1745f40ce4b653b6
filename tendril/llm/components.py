"""Connected components of an edge table by alternating large and small stars.

Each round every node links its larger neighbours to the smallest node it
knows (large star), then its smaller ones (small star), until nothing changes;
the edges are then stars around each component's smallest node.  Every step is
an aggregate and an equi-join on a node in which nodes of very many edges are
spread over all tasks, so no component is ever gathered, and each round is
stored in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendril.llm.common import cut, spread_join


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.union(up).groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    least = least.where("n > 0").select("u", F.least("u", "m").alias("m"), "n")
    return spread_join(up, least, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = spread_join(edges, least, "u", "n", total).where("v <> m")
    return least.select("u", F.col("m").alias("v")).union(moved.select(F.col("v").alias("u"), F.col("m").alias("v")))


def _digest(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of an edge; ``root`` is the smallest node reachable.

    Loops and repeated edges are allowed, rows with a null end are ignored; an
    empty table gives an empty one."""
    e = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = _digest(e)
    while seen[0]:
        e = cut(_small_star(_large_star(e, seen[0]).distinct(), seen[0]).distinct())
        now = _digest(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
