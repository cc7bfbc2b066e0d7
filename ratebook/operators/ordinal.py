"""Row numbering and last-wins without one task per group.

``row_number().over(Window.partitionBy(g).orderBy(k))`` sorts each group in
one task; a group holding a third of all rows then runs in one task. Here the
rows are range-partitioned by the whole key (group and all order columns), so
the splitters cut a hot group into as many parts as it needs, whatever its first
order column holds. The sorted parts are written once, each row with its part
and its place there; a table of one row per (group, part) then gives the exact
numbers. What is numbered are the written rows, so recomputation after a lost
executor cannot move a row to another part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratebook.operators.staging import written


def ranked_parts(df: DataFrame, keys: list[str], num_parts: int | None = None) -> DataFrame:
    """``df`` sorted by the whole key over ranges of it, with ``_part`` and the place in it, ``_at``."""
    by = [F.col(f"`{k}`") for k in keys]
    ranged = df.repartitionByRange(num_parts, *by) if num_parts else df.repartitionByRange(*by)
    return written(ranged.sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
                   .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")


def number_rows(df: DataFrame, order_cols, group_cols=(), out: str = "row_no",
                num_parts: int | None = None) -> DataFrame:
    """Add a 1-based ``out`` number per group in ``order_cols`` order.

    ``order_cols`` must be unique within a group (a total order).
    """
    group_names = list(group_cols)
    placed = ranked_parts(df, [*group_names, *order_cols], num_parts)
    # a group lies in neighbouring parts: this table has at most groups + parts rows
    counts = placed.groupBy(*[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(group_names)], F.col("_part").alias("_gp")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(group_names))]).orderBy("_gp").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).drop("_n", "_from")
    # null-safe: a null group key is a group like any other
    match = F.col("_part") == F.col("_gp")
    for i, g in enumerate(group_names):
        match = match & F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}"))
    return (placed.join(offsets, match).withColumn(out, (F.col("_off") + F.col("_at") + 1).cast("bigint"))
            .drop("_part", "_at", "_off", "_gp", *[f"_g{i}" for i in range(len(group_names))]))


def last_wins(df: DataFrame, key_cols, ordinal: str | Column) -> DataFrame:
    """Keep, per key, the row with the greatest ordinal (a later duplicate replaces an earlier).

    One aggregate with partial (map-side) aggregation: each task keeps one row
    per key before the shuffle, so a hot key costs one row per task.
    """
    ordinal_col = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    value_cols = [c for c in df.columns if c not in key_cols]
    packed = F.struct(ordinal_col.alias("_o"), *[F.col(c) for c in value_cols])
    return (df.groupBy(*key_cols)
            .agg(F.max(packed).alias("_row"))
            .select(*key_cols, *[F.col("_row")[c].alias(c) for c in value_cols]))
