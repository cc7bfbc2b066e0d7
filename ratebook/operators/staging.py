"""Projection barrier: compute a stage's columns once per row.

Catalyst merges consecutive projections and substitutes an expression for
every reference to its alias. When an expensive expression (a regex parse,
a table parse) is referenced several times - or inside a lambda evaluated
per array element - it is then recomputed each time, and a long chain can
exceed the 64 KB limit of generated methods. A one-row ``inline`` is a
Generate node, which projections are not merged across, so the columns
produced below it are plain inputs above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: what several branches
    of a job read is computed once, and a lost executor costs no more than a file read."""
    from ratebook.session import scratch_dir
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def barrier(df: DataFrame) -> DataFrame:
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
