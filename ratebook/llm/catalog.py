"""Queries of the package: one per operator, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.llm.common import staged, table
from ratebook.llm.divergence import oracle as divergence_sql
from ratebook.llm.divergence import source_divergence
from ratebook.llm.hard_negatives import hard_negatives
from ratebook.llm.hard_negatives import oracle as negatives_sql
from ratebook.llm.hilbert_ann import nearest_neighbours
from ratebook.llm.licenses import oracle as license_sql
from ratebook.llm.licenses import scan_licenses
from ratebook.llm.matrix_bpe import ids_text, round_trip
from ratebook.llm.mixing import mixture, source_weights
from ratebook.llm.packing import pack_documents
from ratebook.llm.pii import BASE_KINDS, digest, find_pii, of_kind
from ratebook.llm.pu_classifier import THRESHOLD, fit_pu, pu_scores
from ratebook.llm.quality_rules import fit_rules, quality_rules
from ratebook.llm.simhash import simhash_groups
from ratebook.llm.suffix_dedup import repeated_strings
from ratebook.llm.textstats import BASE
from ratebook.llm.token_counts import token_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def fold_of(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


@register("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


@register("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    held = fold_of(F.col("doc_id")) == 2
    model = fit_pu(docs, labels, learn=~held)
    scored = pu_scores(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@register("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, forest, keep=["doc_id"]).select("doc_id", *BASE, "base_failed", "kept")


@register("op4_hilbert_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@register("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@register("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    spans = F.col("pii")
    return found.select("doc_id", *[F.size(of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(digest(of_kind(spans, *BASE_KINDS)), 256).alias("base_sha256"),
                        digest(spans).alias("spans"))


@register("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                       "component_id")


@register("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    counted = staged(token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "source"])
                     .select("doc_id", "source", "n_tokens"), "counted")
    weights = source_weights(counted, "source", "n_tokens", evenness=0.5, max_epochs=4.0)
    return mixture(counted, counted, weights, "doc_id", "source", "n_tokens", unread=True)


@register("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_strings(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                         "kept_sha256")


TREE_PATH = ("'/' || source || '/' || lang || case when doc_id % 4 = 0 then '/LICENSE-' else '/d' || cast(doc_id % 5 as {text}) "
             "|| '/e' || cast(doc_id % 3 as {text}) || '/' end || cast(doc_id as {text})")


@register("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree with several levels: every fourth one is a licence file above the others of its source and language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return scan_licenses(docs, F.expr(TREE_PATH.format(text="string")), keep=["doc_id"])


SQL["op9_license_scan"] = license_sql("doc_id", TREE_PATH.format(text="varchar"), "documents")


@register("op11_source_divergence")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SQL["op11_source_divergence"] = divergence_sql("documents")


@register("op12_hard_negatives")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label_col=label)


SQL["op12_hard_negatives"] = negatives_sql("embeddings")


@register("op13_bpe_codec")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = round_trip(docs, *files)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.expr(ids_text("ids")).cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
