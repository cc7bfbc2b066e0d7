"""Table and CSV readers (S2, S5, S6 helpers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Cell texts a pandas CSV read treats as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv_text(spark: SparkSession, path, header: bool = True) -> DataFrame:
    """All-string CSV read (no inference), quoted line breaks allowed."""
    return csv_reader(spark, header).csv(path)


def csv_reader(spark: SparkSession, header: bool = True):
    """The one CSV dialect of the engine: text cells, quoted line breaks, quotes doubled inside quotes."""
    return (spark.read.option("header", header).option("multiLine", True).option("escape", '"')
            .option("inferSchema", False).option("encoding", "UTF-8"))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", usecols=None) -> DataFrame:
    """Read one table, optionally a column subset (a missing column is an analysis error)."""
    df = csv_reader(spark).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    if usecols:
        missing = [c for c in usecols if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {', '.join(missing)}")
        df = df.select(*usecols)
    return df
