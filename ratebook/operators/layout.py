"""Template filling: cleaning, cell aggregates (C5) and paged cell layout."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratebook.functions.text import try_cast
from ratebook.operators.mapping import check_fixed_mapping


def drop_fill(df: DataFrame, dropna_columns=None, fillna=None) -> DataFrame:
    """F8: drop rows null in the listed columns, then fill nulls (one value or per column).

    An empty fill value (0, ``""``, an empty table) means no filling.
    """
    out = df.na.drop(subset=list(dropna_columns)) if dropna_columns else df
    if not fillna:
        return out
    if isinstance(fillna, dict):
        return out.na.fill({k: v for k, v in fillna.items() if k in out.columns})
    return out.na.fill(fillna)


NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def as_number(col: str) -> Column:
    """A cell as a double; what is not written like a number, and NaN, is 0."""
    text = F.col(f"`{col}`").cast("string")
    value = F.when(text.rlike(NUMBER), try_cast(F.trim(text), "double"))
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


@dataclass(frozen=True)
class Cell:
    """A template cell, parsed once: how it is made and from what."""

    kind: str
    argument: object = None


#: Fixed prefixes of computed cells.
PREFIXES = {"sum:": "sum", "first:": "first", "$profile.": "profile"}


def parse_cell(expr) -> Cell:
    text = expr.strip() if isinstance(expr, str) else None
    if text is None:
        return Cell("literal", None if expr is None else str(expr))
    if text.lower() == "today":
        return Cell("today")
    prefix = next((p for p in PREFIXES if text.startswith(p)), None)
    return Cell(PREFIXES[prefix], text[len(prefix):]) if prefix else Cell("literal", text)


def _look_up(profile, path: str):
    """The value at a dotted path of attributes and keys, or None."""
    def step(held, part):
        return getattr(held, part, held.get(part) if isinstance(held, dict) else None)
    return reduce(step, path.split("."), profile)


def _sum_cell(argument, columns, **_):
    """A1: numbers added (bad and null count 0); an unknown column sums to 0."""
    return F.coalesce(F.sum(as_number(argument)), F.lit(0.0)) if argument in columns else F.lit(0.0)


def _first_cell(argument, columns, ordinal, **_):
    """A2: the first non-null in row order; null for an unknown column."""
    if argument not in columns:
        return F.lit(None).cast("string")
    value = F.col(f"`{argument}`").cast("string")
    return F.min_by(value, F.when(value.isNotNull(), F.col(ordinal)))


def _literal(value) -> Column:
    return F.lit(None if value is None else str(value)).cast("string")


CELL_KINDS = {
    "sum": _sum_cell,
    "first": _first_cell,
    "today": lambda argument, today, **_: _literal((today or dt.date.today()).isoformat()),
    "profile": lambda argument, profile, **_: _literal(_look_up(profile, argument)),
    "literal": lambda argument, **_: _literal(argument),
}


def fill_cells(df: DataFrame, cells: dict, group_cols=("source_file",), ordinal: str = "source_row",
               profile=None, today: dt.date | None = None, clean: dict | None = None) -> DataFrame:
    """Per input file, every template cell in ONE aggregate -> (file, cell, value, number).

    Sums are in ``number`` as doubles, all else in ``value`` as text. Partial
    aggregation keeps one row per (task, file) before the shuffle, so a file
    holding a third of all rows is combined map-side.
    """
    clean = clean or {}
    src = drop_fill(df, clean.get("dropna_columns"), clean.get("fillna"))
    made = {name: parse_cell(expr) for name, expr in cells.items()}
    around = dict(columns=set(src.columns), ordinal=ordinal, profile=profile, today=today)
    agg = src.groupBy(*group_cols).agg(*[CELL_KINDS[c.kind](c.argument, **around).alias(f"c{i}")
                                         for i, c in enumerate(made.values())])

    def row(i, name, cell):
        held, none = F.col(f"c{i}"), F.lit(None)
        number = cell.kind == "sum"
        return F.struct(F.lit(name).alias("cell"), (none.cast("string") if number else held).alias("value"),
                        (held if number else none.cast("double")).alias("number"))
    return agg.select(*group_cols, F.inline(F.array(*[row(i, n, c) for i, (n, c) in enumerate(made.items())])))


@dataclass
class FixedMapping:
    """K7 config: sheet, first data row, source column -> column letter, page size."""

    sheet: str
    start_row: int
    columns: dict = field(default_factory=dict)
    header_row: int | None = None
    max_rows_per_sheet: int | None = None

    @classmethod
    def from_dict(cls, data: dict) -> "FixedMapping":
        for key in ("sheet", "start_row", "columns"):
            if key not in data:
                raise ValueError(f"fixed mapping needs '{key}'")
        return cls(sheet=data["sheet"], start_row=int(data["start_row"]), columns=dict(data["columns"]),
                   header_row=data.get("header_row"), max_rows_per_sheet=data.get("max_rows_per_sheet"))


def page_index(df: DataFrame, order_cols, group_cols=(), page_size: int | None = None,
               row_col: str = "_row_no") -> DataFrame:
    """0-based page and offset per row in row order; size null or <= 0 -> one page.

    Rows are numbered per template key with the bucketed two-pass numbering
    (no single-task window over a hot key).
    """
    from ratebook.operators.ordinal import number_rows
    numbered = number_rows(df, order_cols, group_cols, out=row_col)
    zero = F.col(row_col) - 1
    if not page_size or page_size <= 0:
        return numbered.withColumn("page", F.lit(0).cast("bigint")).withColumn("offset", zero)
    return (numbered.withColumn("page", F.floor(zero / F.lit(page_size)).cast("bigint"))
            .withColumn("offset", (zero % F.lit(page_size)).cast("bigint")))


def part_name(base_name: str, page: Column) -> Column:
    """Page 0 keeps the output name; page n gets ``_part{n+1}`` before the extension."""
    stem, dot, ext = base_name.rpartition(".")
    if not dot:
        stem, ext = base_name, ""
    suffix = f".{ext}" if dot else ""
    return F.when(page == 0, F.lit(base_name)).otherwise(
        F.concat(F.lit(stem + "_part"), (page + 1).cast("string"), F.lit(suffix)))


def cell_layout(df: DataFrame, mapping: FixedMapping, base_name: str, order_cols,
                group_cols=()) -> DataFrame:
    """K7: (group..., part_name, cell_ref, value) for every mapped cell of every row.

    A dry run is this frame without a write; a write partitions it by part.
    """
    check_fixed_mapping(df.columns, mapping.columns)
    paged = page_index(df, order_cols, group_cols, mapping.max_rows_per_sheet)
    cells = F.array(*[F.struct(F.lit(letter).alias("letter"), F.col(f"`{src}`").cast("string").alias("value"))
                      for src, letter in mapping.columns.items()])
    out = paged.select(*group_cols, part_name(base_name, F.col("page")).alias("part_name"),
                       (F.col("offset") + mapping.start_row).alias("row_ref"), F.explode(cells).alias("c"))
    return out.select(*group_cols, "part_name",
                      F.concat(F.col("c.letter"), F.col("row_ref").cast("string")).alias("cell_ref"),
                      F.col("c.value").alias("value"))


def write_layout(cells: DataFrame, out_dir: str, dry_run: bool = False) -> DataFrame:
    """K7 output: one folder per part, as the template has one file per part; a dry run
    returns the planned parts only."""
    parts = cells.select("part_name").distinct()
    if not dry_run:
        cells.write.mode("errorifexists").partitionBy("part_name").parquet(out_dir)
    return parts
