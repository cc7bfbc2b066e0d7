"""Rate lookups for conversion: as-of with a day limit (J4) and static.

The as-of lookup never compares ranges: each stored rate is copied forward
onto the days it may serve (its own day and the next ``window`` days), the
latest rate wins per (currency, day), and rows are matched by an equi join
on (currency, day). The expanded side is bounded by pairs x days x
(window + 1), independent of the number of rows converted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.functions.text import try_cast
from ratebook.schemas import EXCHANGE_RATE


def daily_effective_rates(rates: DataFrame, quote: str, window_days: int = 7) -> DataFrame:
    """(from_ccy, day) -> (rate, rate_day) for lookups into ``quote``.

    ``rate_day`` is ``day`` itself when a rate exists that day, else the
    nearest earlier day within ``window_days``.
    """
    r = (rates.where(F.upper(F.col("quote_currency")) == quote.upper())
         .where(F.col("rate_date").isNotNull() & F.col("rate_mid").isNotNull())
         .select(F.upper(F.col("base_currency")).alias("from_ccy"), "rate_date", "rate_mid"))
    spread = r.select("from_ccy", "rate_date", "rate_mid",
                      F.explode(F.sequence(F.lit(0), F.lit(int(window_days)))).alias("_off"))
    spread = spread.select("from_ccy", F.date_add("rate_date", F.col("_off")).alias("day"),
                           "rate_date", "rate_mid")
    # primitive aggregation buffers keep this a hash aggregate with map-side combining
    best = spread.groupBy("from_ccy", "day").agg(
        F.max_by("rate_mid", "rate_date").alias("rate"), F.max("rate_date").alias("rate_day"))
    return best.select("from_ccy", "day", F.col("rate").cast(EXCHANGE_RATE).alias("rate"), "rate_day")


def lookup_asof(df: DataFrame, rates: DataFrame, base_currency: str, window_days: int = 7,
                currency: str = "currency", date: str = "date", eligible=None) -> DataFrame:
    """Add ``_rate``, ``_rate_day`` and ``_rate_issue`` to eligible rows.

    Same currency -> 1 on the row's date; exact day; else the nearest earlier
    day within the window (issue ``rate_fallback``); else ``rate_unavailable``.
    Rows not eligible (missing amount, currency or date) get nulls and no issue.
    """
    base = base_currency.upper()
    eff = daily_effective_rates(rates, base, window_days)  # joined by its runtime size
    ccy = F.upper(F.col(currency))
    elig = F.lit(True) if eligible is None else eligible
    elig = elig & F.col(currency).isNotNull() & F.col(date).isNotNull()
    probe = df.withColumn("_elig", elig).withColumn("_same", ccy == F.lit(base))
    # Only eligible, non-identity rows carry a join key; the others cannot match.
    probe = probe.withColumn("_k_ccy", F.when(F.col("_elig") & ~F.col("_same"), ccy))
    joined = probe.join(eff, (F.col("_k_ccy") == eff["from_ccy"]) & (F.col(date) == eff["day"]), "left")
    rate = F.when(F.col("_elig") & F.col("_same"), F.lit(1).cast(EXCHANGE_RATE)) \
        .when(F.col("_elig"), F.col("rate"))
    rate_day = F.when(F.col("_elig") & F.col("_same"), F.col(date)) \
        .when(F.col("_elig"), F.col("rate_day"))
    issue = (F.when(~F.col("_elig"), F.lit(None).cast("string"))
             .when(F.col("_same"), F.lit(None).cast("string"))
             .when(F.col("rate").isNull(), F.lit("rate_unavailable"))
             .when(F.col("rate_day") != F.col(date), F.lit("rate_fallback")))
    return (joined.withColumn("_rate", rate).withColumn("_rate_day", rate_day)
            .withColumn("_rate_issue", issue)
            .drop("from_ccy", "day", "rate", "rate_day", "_k_ccy", "_same", "_elig"))


def lookup_static(df: DataFrame, base_currency: str, overrides: dict | None = None,
                  default_rate: str = "1", currency: str = "currency", date: str = "date",
                  eligible=None) -> DataFrame:
    """Same currency -> 1; a pair override; else the default rate.

    Overrides are a config-sized literal map, so the lookup is a map access
    (no join, no shuffle).
    """
    base = base_currency.upper()
    ccy = F.upper(F.col(currency))
    elig = F.lit(True) if eligible is None else eligible
    elig = elig & F.col(currency).isNotNull() & F.col(date).isNotNull()
    pairs = {f.upper(): v for (f, t), v in (overrides or {}).items() if t.upper() == base}
    if pairs:
        m = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(str(v)))])
        override = try_cast(F.try_element_at(m, ccy), EXCHANGE_RATE.simpleString())
    else:
        override = F.lit(None).cast(EXCHANGE_RATE)
    rate = (F.when(~elig, F.lit(None).cast(EXCHANGE_RATE))
            .when(ccy == base, F.lit(1).cast(EXCHANGE_RATE))
            .otherwise(F.coalesce(override, F.lit(default_rate).cast(EXCHANGE_RATE))))
    return (df.withColumn("_rate", rate)
            .withColumn("_rate_day", F.when(elig, F.col(date)))
            .withColumn("_rate_issue", F.lit(None).cast("string")))
