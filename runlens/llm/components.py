"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.staging import staged


def least_below(edges: DataFrame) -> DataFrame:
    """(w, m): the smallest of the smaller neighbours of each upper end."""
    return edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every upper end moves from its lower end to the smallest neighbour of that one."""
    moved = edges.join(least_below(edges), F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v"))
    return moved.distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every id and its smaller neighbours hang on the smallest of them."""
    hung = edges.join(least_below(edges), F.col("u") == F.col("w"))
    ends = hung.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return ends.where("u != v").distinct()


def all_stars(edges: DataFrame) -> bool:
    """Whether every id is either a centre or hangs on one centre."""
    roles = F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
                    F.struct(F.col("v").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    ids = edges.select(F.inline(roles)).groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return ids.where("hangs > 1 OR (hangs = 1 AND holds = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every end of a link (u, v); label is the smallest id that can be reached.

    Links first become a star around the smallest of each id's smaller neighbours, so a group of n ids that share
    leads has few more than n links from then on. Large and small stars then alternate until only stars are left; rounds
    grow with the logarithm of a path's length. Every round is a written table. Links from an id to itself and
    repeated links change nothing; without links there are no rows.
    """
    ends = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    edges = staged(small_star(ends.where("u != v").distinct()), "edges")
    while not all_stars(edges):
        edges = staged(small_star(large_star(edges)), "edges")
    ids = ends.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return staged(
        ids.join(edges, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("label")), "labels"
    )
