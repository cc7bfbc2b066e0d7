"""The corpus pipeline stage by stage against brute force, on the small table and on messy rows."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from ratebook.llm.common import staged, table
from tests.conftest import ROOT, SMALL
from tests.llm import messy
from tests.llm.test_group_operators import brute_components, brute_fingerprint
from tests.llm.test_text_operators import brute_spans, brute_statistics, check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SMALL, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SMALL), name)
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "pii", "mixing", "packing"]
    assert all(df.columns == COLUMNS for df in steps[:-1])


def test_rules_stage_keeps_what_the_query_keeps(spark, steps):
    kept = {r.doc_id for r in __spark_entry__.queries()["op3_quality_rules"](spark, SMALL).where("kept").collect()}
    assert Counter(rows(steps[1])) == Counter(r for r in rows(steps[0]) if r[0] in kept)
    for r in rows(steps[0]):
        n, *_, repeats = brute_statistics(r[1])
        if n < 50 or 100 * repeats > 50 * n:
            assert r[0] not in kept


def test_dedup_stage_keeps_one_of_each_group(steps):
    before = rows(steps[1])
    groups = brute_components([(r[0], brute_fingerprint(r[1])) for r in before])
    assert Counter(rows(steps[2])) == Counter(r for r, (i, c) in zip(before, groups) if i == c)


def test_pii_stage_masks_and_changes_nothing_else(steps):
    before = {r[0]: r for r in rows(steps[2])}
    after = {r[0]: r for r in rows(steps[3])}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert (r[0], *r[2:]) == (before[i][0], *before[i][2:])
        assert not brute_spans(r[1])
        if not brute_spans(before[i][1]) and "[" not in r[1]:
            assert r[1] == before[i][1]


def test_mixing_stage_repeats_within_the_limit(steps):
    before, after = Counter(rows(steps[3])), Counter(rows(steps[4]))
    assert before.keys() == after.keys()
    assert all(before[r] <= n <= corpus_pipeline.MAX_EPOCHS * before[r] for r, n in after.items())


def test_packing_stage_round_trip(steps):
    docs = [r[:2] for r in rows(steps[4])]
    check_packing(steps[5].collect(), docs)


def test_run_gives_the_stages_result(spark, steps):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == steps[5].columns
    assert got.agg(F.sum("length")).first()[0] == steps[5].agg(F.sum("length")).first()[0]
    assert __spark_entry__.queries()["pipeline"] and "pipeline" not in __spark_entry__.oracle_sql()


def test_messy_and_empty_tables_pass_through_every_stage(spark):
    for docs in (messy.frame(spark), messy.empty(spark)):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[1:4]:
            docs = staged(stage(spark, docs, SMALL), name)
            assert docs.columns == names
        corpus_pipeline.packing_stage(spark, docs, SMALL).collect()
    kept = corpus_pipeline.rules_stage(spark, messy.frame(spark), SMALL)
    assert kept.columns == messy.frame(spark).columns and kept.where("text is null or text = ''").count() == 0
    deduped = corpus_pipeline.dedup_stage(spark, messy.frame(spark), SMALL).collect()
    want = {c for _, c in brute_components([(r[0], brute_fingerprint(r[1])) for r in messy.rows()])}
    assert {r.doc_id for r in deduped} == want


def test_the_rest_works_without_the_package(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = ("import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q); "
            "assert 'pipeline' not in q and not any(n.startswith('op1') for n in q)")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": ""})


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
