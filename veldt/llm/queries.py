"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embeddings, html_text, licenses, minhash, oracles, packing, quality, secrets, toxicity
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


#: A conversation that holds the control strings of a template in its texts.
_CONTROL_CHAT = """
SELECT CAST(conv AS {conv}) AS conv_id, CAST(turn AS {turn}) AS turn, role, text
FROM VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]') AS v(conv, turn, role, text)
"""


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    types = {k: v for k, v in rows.dtypes}
    more = spark.sql(_CONTROL_CHAT.format(conv=types["conv_id"], turn=types["turn"]))
    return chat.digest(chat.format_chats(rows.unionByName(more)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def _held_out(doc_id: str):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """The model of the rows that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.train(docs, labels.where(~_held_out("doc_id")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), with_ids=False)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html_text.extract(table(spark, sf_dir, "pages"))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_chat_formatting": op3_chat_formatting,
        "op7_quality_rules": op7_quality_rules,
        "op4_embedding_near_dedup": op4_embedding_near_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op8_bpe_encode_decode": op8_bpe_encode_decode,
        "op9_license_scan": op9_license_scan,
        "op10_html_extraction": op10_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
