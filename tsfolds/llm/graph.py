"""Connected components of a link table, by alternating large and small stars; a join for groups of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfolds.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b: long): component is the smallest node reachable.

    Each step gives every node's neighbours the least node it knows of, as a grouped minimum joined
    back, so no group is gathered; the table is cut after each step and the number of steps grows with
    the logarithm of a component's size.  Nulls and self-links are left out; no links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges, seen = cut(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # of each node, the neighbours above it move to its least; of those below it, the least stays
        moved = F.when(F.col("v") > F.col("u"), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))).when(F.col("v") == F.col("m"), F.struct("u", "v"))
        large = both.join(least, "u").select(moved.alias("e")).select("e.u", "e.v").where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )



def copies_join(rows: DataFrame, groups: DataFrame, on: list[str], by: str, parts: int = 32) -> DataFrame:
    """Left join of rows to the few ``groups`` that hold several rows.  A group may hold a third of all rows:
    they are dealt to ``parts`` parts by a hash of ``by``, and each group's row goes to all of them."""
    part = F.pmod(F.xxhash64(by), F.lit(parts)).cast("int").alias("_part")
    dealt = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    return rows.select("*", part).join(dealt, [*on, "_part"], "left").drop("_part")
