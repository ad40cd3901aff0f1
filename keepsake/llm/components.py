"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import discard, written


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``): the smallest node reachable.

    Each step ties the neighbours of a node to the smallest of them. Minima are combined before the shuffle and no
    list of neighbours is ever collected; the number of steps grows with the logarithm of the longest path.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
                    "stars")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, edges = edges, written(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(old)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).distinct()


def joined_components(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``node, root`` once more ``links`` are known than those behind ``roots``. Only the links between roots are followed, and the
    tables of before are deleted."""
    if roots is None:
        return written(connected_components(links), "roots")
    one, two = roots.toDF("a", "root_a"), roots.toDF("b", "root_b")
    between = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    more = written(connected_components(between), "roots")
    moved = more.toDF("was", "now")
    kept = roots.join(moved, roots["root"] == moved["was"], "left").select("node", F.coalesce("now", "root").alias("root"))
    out = written(kept.unionByName(more.join(roots, "node", "left_anti").select("node", "root")), "roots")
    discard(roots, more)
    return out
