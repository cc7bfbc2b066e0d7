"""C1 process_forms: many form files -> canonical rows -> typed -> converted -> validated.

One lazy plan. The only shuffle-capable step is the rate join, whose rate
side is bounded by pairs x days and broadcast after a size check. Outputs
are written once, partitioned by status, so the accepted, rejected and
need-confirm sets come from one pass without caching the frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.operators.forms import clean_forms, convert, validate
from ratebook.operators.mapping import (DEFAULT_MAPPING, MappingConfig, MappingResult, add_constants,
                                        apply_column_mapping, union_by_name)

LINEAGE = ("source_file", "source_row")

# Output column order of the processed frame (canonical columns come first).
OUTPUT_TAIL = ("source_file", "source_row", "base_currency", "exchange_rate", "base_amount",
               "rate_date_used", "issues", "status", "need_confirm")


@dataclass
class FormsConfig:
    base_currency: str = "CNY"
    round_digits: int = 2
    confirm_over_amount: float = 20000
    window_days: int = 7


@dataclass
class FormsResult:
    processed: DataFrame
    diagnostics: list[tuple[str, MappingResult]]

    @property
    def accepted(self) -> DataFrame:
        return self.processed.where(F.col("status") == "ok")

    @property
    def rejected(self) -> DataFrame:
        return self.processed.where(F.col("status") != "ok")

    @property
    def need_confirm(self) -> DataFrame:
        return self.processed.where((F.col("status") == "ok") & F.col("need_confirm"))


def map_files(files: list[tuple[str, DataFrame]], mapping: MappingConfig) -> tuple[DataFrame, list]:
    """Map each file's header, add constants, union by name."""
    if not files:
        raise ValueError("no input files provided")
    mapped, diags = [], []
    for name, frame in files:
        passthrough = tuple(c for c in frame.columns if c in LINEAGE or c.startswith("_"))
        result = apply_column_mapping(frame, mapping, passthrough=passthrough)
        diags += [(one, result) for one in (name if isinstance(name, tuple) else (name,))]
        mapped.append(add_constants(result.frame, mapping.computed))
    return union_by_name(mapped), diags


def process_forms(files: list[tuple[str, DataFrame]], mapping: MappingConfig = DEFAULT_MAPPING,
                  config: FormsConfig | None = None, rates: DataFrame | None = None,
                  static_overrides: dict | None = None, default_rate: str = "1",
                  decisions: DataFrame | None = None) -> FormsResult:
    """Run the whole form job lazily; ``rates`` selects the as-of lookup, else static."""
    config = config or FormsConfig()
    threshold = mapping.confirm_over_amount if mapping.confirm_over_amount is not None \
        else config.confirm_over_amount
    combined, diags = map_files(files, mapping)
    cleaned = clean_forms(combined)
    converted = convert(cleaned, config.base_currency, config.round_digits, rates,
                        config.window_days, static_overrides, default_rate)
    validated = validate(converted, mapping, config.round_digits, threshold, decisions)
    head = [c for c in mapping.input_columns]
    rest = [c for c in validated.columns if c not in head and c not in OUTPUT_TAIL]
    ordered = validated.select(*head, *rest, *OUTPUT_TAIL)
    return FormsResult(ordered, diags)


def outcome_counts(processed: DataFrame) -> DataFrame:
    """A3: ok, rejected and need-confirm counts in one aggregate."""
    ok = F.col("status") == "ok"
    return processed.agg(
        F.count_if(ok).alias("ok_rows"),
        F.count_if(~ok).alias("rejected_rows"),
        F.count_if(ok & F.col("need_confirm")).alias("need_confirm_rows"))
