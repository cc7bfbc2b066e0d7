"""Driver contract, plan shape and invariance checks."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SMALL


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "issues" in df.columns and "status" in df.columns


def test_every_oracle_has_a_query():
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 100


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")
BAD_JOINS = ("BroadcastNestedLoopJoin", "CartesianProduct")


@pytest.mark.parametrize("name", ["process_forms", "rate_lookup_asof", "rates_upsert", "monthly_rate_lookup",
                                  "source_routing", "extract_quotes", "extract_links", "batch_report",
                                  "cell_layout", "fill_template", "import_rates"])
def test_plan_shape(spark, name):
    """No Python UDF in the plan and no nested-loop or cartesian join."""
    df = entry.queries()[name](spark, SMALL)
    plan = _plan(df)
    for node in PYTHON_NODES + BAD_JOINS:
        assert node not in plan, f"{name}: {node}"


def test_scan_prunes_columns(spark):
    df = entry.queries()["scan_usecols"](spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text.replace(
        "\n", " ") or "l_shipdate" not in text


def test_range_query_pushes_filters(spark, tmp_path):
    from ratebook.operators.store import range_query
    from ratebook.sinks.store import RateStore
    from ratebook.sources.bindings import stored_rates
    store = RateStore(spark, str(tmp_path / "s"))
    store.write(stored_rates(spark, SMALL, even_days=False))
    df = range_query(store.read(), "usd", "cny", "1997-01-01", "1997-12-31")
    plan = _plan(df)
    assert "PushedFilters" in plan and "base_currency" in plan
    assert "PartitionFilters" in plan and "year" in plan


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("name", ["process_forms", "rates_upsert", "monthly_upsert", "batch_report", "page_index",
                                  "source_routing", "link_dedupe", "folder_resolve", "cell_layout",
                                  "monthly_rate_lookup", "extract_quotes"])
def test_same_result_for_1_and_16_partitions(spark, name):
    q = entry.queries()[name]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = _rows(q(spark, SMALL))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    b = _rows(q(spark, SMALL))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_numbering_ignores_input_order(spark):
    from ratebook.operators.ordinal import number_rows
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("g"), F.col("id").alias("k"))
    a = _rows(number_rows(df, ["k"], ["g"]))
    b = _rows(number_rows(df.repartition(13).orderBy(F.rand(7)), ["k"], ["g"], num_parts=5))
    assert a == b
    first = number_rows(df, ["k"], ["g"]).where("row_no = 1").orderBy("g").collect()
    assert [r["k"] for r in first] == list(range(7))


def test_numbering_with_a_hot_group(spark):
    """One group holds a third of all rows: numbers stay exact and every part stays near
    n / parts rows, also where the first order column has one value."""
    from ratebook.operators.ordinal import number_rows, ranked_parts
    n, parts = 30000, 12
    df = spark.range(0, n).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("g"),
                                  F.lit("same").alias("first"), F.col("id").alias("k"))
    out = number_rows(df, ["first", "k"], ["g"], num_parts=parts)
    hot = out.where("g = 0").agg(F.min("row_no"), F.max("row_no"), F.count_distinct("row_no")).first()
    assert tuple(hot) == (1, n // 3, n // 3)
    assert out.where("g = 0 and row_no <> k / 3 + 1").count() == 0
    sizes = ranked_parts(df, ["g", "first", "k"], parts).groupBy("_part").count().agg(F.max("count")).first()[0]
    assert sizes <= 1.5 * n / parts


def test_rate_lookup_is_a_broadcast_equi_join(spark):
    """J4 joins forms to the size-checked daily rate table by (currency, day) without shuffling forms."""
    df = entry.queries()["rate_lookup_asof"](spark, SMALL)
    plan = _plan(df)
    assert "BroadcastHashJoin" in plan and "LeftOuter" in plan
    assert "BroadcastNestedLoopJoin" not in plan and "SortMergeJoin" not in plan


def test_form_job_ignores_input_partitioning(spark):
    """Forms shuffled into other partitions give the same processed rows."""
    from ratebook.plans.process_forms import process_forms
    from ratebook.sources.bindings import form_files, rates_view
    files = form_files(spark, SMALL)
    rates = rates_view(spark, SMALL)
    a = _rows(process_forms(files, rates=rates).processed.drop("issues"))
    shuffled = [(n, f.repartition(7, F.rand(3))) for n, f in files]
    b = _rows(process_forms(shuffled, rates=rates.repartition(5)).processed.drop("issues"))
    assert a == b
