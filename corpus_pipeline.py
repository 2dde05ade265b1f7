"""A pipeline over ``documents``: each stage applies one operator to all that the stage before kept.

Toxicity, then quality rules, drop the documents that they reject (quality rules also take their
frequent lines out of the others); near-dedup keeps one document of each group; the secret scan
replaces every secret by a mark; packing cuts the rest into pieces and places them in sequences.
Every stage but the last returns the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm import minhash, packing, quality, queries, secrets, toxicity
from veldt.llm.common import cut, drop_cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text is now, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, queries.toxicity_model(spark, docs, sf_dir))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A copied text stays in its first document, for near-dedup to find.
    return _sized(quality.clean(docs, contents=True, keep_first=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", hide_secrets),
    ("best_fit_packing", pack),
]

#: SQL can't express trees, weighted samples or tokenisers; the tests run each stage against a plain form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            made = cut(made)
            drop_cut(docs)
        docs = made
    return docs
