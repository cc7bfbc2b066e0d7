"""From raw documents to packed training sequences: five stages, each one operator of ``ratebook.llm``.

quality rules -> SimHash near-dedup -> personal data masked -> sources mixed -> packing

Each stage takes (spark, docs, sf_dir); all but the last return the columns
they got. Columns beside doc_id, text and source pass through under any name.
Null and empty texts fail the quality rules and go in the first stage. An
empty table passes through every stage as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.llm.common import col, staged, table
from ratebook.llm.mixing import budgeted_copies, repeated, source_weights
from ratebook.llm.packing import pack_documents
from ratebook.llm.pii import redact
from ratebook.llm.quality_rules import fit_rules, quality_rules
from ratebook.llm.simhash import simhash_groups
from ratebook.llm.token_counts import token_counts

#: No source is read more often than this in one pass over the mixture; every document is read at least once.
MAX_EPOCHS = 2.0


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that clash with nothing, and the new name of each column."""
    names = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    own, name = _numbered(docs)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(name["doc_id"]), "quality")
    forest = fit_rules(own, labels, text_col=name["text"], id_col=name["doc_id"])
    judged = quality_rules(own, forest, text_col=name["text"])
    return judged.where("kept").select(*[F.col(new).alias(old) for old, new in name.items()])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest doc_id, then the smallest row hash."""
    own, name = _numbered(docs)
    own = own.withColumn("row_", F.xxhash64(*own.columns))
    tagged = simhash_groups(own, shingle=4, max_bits=4, text_col=name["text"], id_col=name["doc_id"],
                            keep=[name["doc_id"], "row_"])
    doc = F.col(name["doc_id"])
    first = (tagged.groupBy("component_fp").agg(F.min(F.struct(doc.isNull().alias("none"), doc.alias("doc"),
                                                               F.col("row_").alias("row"))).alias("f"))
             .select(F.col("f.doc").alias("doc"), F.col("f.row").alias("row")))
    kept = own.join(first, doc.eqNullSafe(F.col("doc")) & (F.col("row_") == F.col("row")), "left_semi")
    once = kept.dropDuplicates([name["doc_id"], "row_"])
    return once.select(*[F.col(new).alias(old) for old, new in name.items()])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind in brackets."""
    own, name = _numbered(docs)
    return redact(own, name["text"]).toDF(*name)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's share of the mixture asks for, once at least."""
    own, name = _numbered(docs)
    counted = staged(token_counts(own, public_tokenizers.path("byte_bpe_50k.json"), text_col=name["text"],
                                  keep=[name["doc_id"], name["source"]]), "counted")
    keys = name["doc_id"], name["source"], "n_tokens"
    weights = source_weights(counted, name["source"], "n_tokens", max_epochs=MAX_EPOCHS, every_source_once=True)
    return repeated(budgeted_copies(own, counted, weights, *keys)).toDF(*name)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences (``with_ids`` in the operator adds their ids)."""
    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("quality_rules", rules_stage),
    ("simhash_dedup", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The boosted verdict, the fingerprints and the token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
