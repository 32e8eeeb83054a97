"""A training-data pipeline over `documents`; part of the optional subpackage `llm`.

Toxic documents go, one document of each group of near copies stays, repeated passages are cut, sources are mixed to
target weights, and what the mix takes is encoded. Every stage works on all rows that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from optrail.llm.chunks import dedup_substrings
from optrail.llm.common import bound_batches, materialize, private, quoted
from optrail.llm.jaccard import join_near
from optrail.llm.mix import in_mix_order, mix_sources
from optrail.llm.queries import token_digests, toxicity_lexicon
from optrail.llm.toxicity import score_toxicity


def shielded(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with its own columns named like ``names``, in any case, renamed, so that an operator's columns do not replace them."""
    taken = {n.lower() for n in names}
    return docs.toDF(*(private(docs, f"{c}_own") if c.lower() in taken else c for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the lexicon is learned from the table `labels`.

    Null and empty texts score as texts without words; repeated rows are judged alike; an empty table gives none.
    """
    bound_batches(spark)
    own = shielded(docs, "score", "predicted", "hits")
    scored = score_toxicity(own, toxicity_lexicon(spark, sf_dir, docs))
    return scored.where("predicted = 0").select(*(quoted(c) for c in own.columns)).toDF(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id in each component of near copies; equal rows of it count once.

    Rows without a doc_id take no part and stay; a document without words is its own component; an empty table gives none.
    """
    bound_batches(spark)
    kept = join_near(docs).where("doc_id = component_id").select("doc_id").distinct()
    first = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.col("source"))
    nth = private(docs, "_nth")
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1)
    return named.drop(nth).select(*(quoted(c) for c in docs.columns)).union(docs.where("doc_id is null"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; those of which nothing is left go.

    Null and empty texts and rows without a doc_id stay as they are; rows alike in both are treated alike; an empty table gives none.
    """
    bound_batches(spark)
    own = shielded(docs, "n_chunks", "removed_bytes", "spans", "copied_from")
    cut = dedup_substrings(own).where("removed_bytes = 0 or trim(text) <> ''")
    cut = cut.withColumn("n_chars", F.when(F.col("removed_bytes") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*(quoted(c) for c in own.columns)).toDF(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in its order.

    Documents without words are not taken; rows alike in doc_id, source and text go as the first of them goes; an empty table gives none.
    """
    bound_batches(spark)
    return in_mix_order(docs, mix_sources(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to, for each row of the mix; null text counts as empty."""
    bound_batches(spark)
    return token_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("mix", mix_to_weights),
    ("bpe", encode),
]

#: Not expressible as a whole in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole of `documents`, each written and read again; an empty table gives none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
