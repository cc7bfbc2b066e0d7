"""Connected components of a link table, by alternating large-star and small-star steps.

Both steps are joins and aggregates on the link table; each round is written
to the shared scratch folder, so lineage stays short and a lost executor
costs one round. A node with very many links is pre-aggregated in the map
tasks, and the joins have plain shuffles on both sides, which adaptive
execution splits where one key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.llm.common import staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every linked node; the root is the smallest node of the component and has no row itself."""
    now = staged(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .distinct(), "links")
    seen = _digest(now)
    while seen[0]:
        # each step sees links with u > v, as both steps keep it so
        now = staged(_small_star(_large_star(now)), "links")
        after = _digest(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
