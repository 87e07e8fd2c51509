"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlist.llm.tables import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every end of an edge; component is the smallest id reachable.

    A round replaces each vertex's links by links to its smallest neighbour, first towards larger
    and then towards smaller neighbours, until only stars are left. The minimum is taken with
    partial aggregation and hot vertices are left to the skew join, so no vertex's neighbours
    meet in one task's memory. Each round is cut by a table in the shared folder.
    An edge from an id to itself keeps the id; nulls are left out; an empty table gives no rows.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null").distinct()
    edges = keep(edges, "edges")
    alone = edges.select(F.col("a").alias("id"))
    alone = alone.unionAll(edges.select(F.col("b").alias("id"))).distinct()
    edges = edges.where("a <> b")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == before or not now.n:
            break
        before = (now.n, now.h)
        edges = keep(_star(_star(edges, True), False), "stars")
    return alone.join(edges.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
