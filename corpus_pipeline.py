"""The corpus pipeline: reject toxic documents, keep one of near-duplicates, cut repeated passages, hide personal data, pack.

Each stage takes what its predecessor kept. All but the last return the columns of ``documents``;
``n_chars`` follows the text. Documents that a stage leaves without a word stay, with an empty text.

Edge cases: a null text is an empty one to every stage and stays null until it is packed as its end token; of rows with one ``doc_id`` each is
judged by its own text, and of those alike in ``doc_id`` and text one stays; rows without a ``doc_id`` stay unless one with a ``doc_id``
is alike; an empty table gives no pieces; other columns are passed through whatever their names, until packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm import packing, pii, simhash, substrings, toxicity
from boutline.llm.common import on_workers
from boutline.sources.scratch import remove, scratch_folder

#: The stages in DuckDB SQL: none, as a trained score, fingerprints and token ids are beyond it.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half; the labels of the corpus train the scorer."""
    on_workers(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_column(docs, model)
    score = scored.columns[-1]
    return scored.where(F.col(score) < 0.5).drop(score)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with linked SimHash fingerprints, or five-word shingles alike to 0.8 or more, and what these connect, the one with the smallest id."""
    on_workers(spark)
    return simhash.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that windows of earlier documents cover already."""
    on_workers(spark)
    return substrings.cut(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, under the secret of the session: equal values stay linked within an application, or wherever the secret is set."""
    hidden = pii.pseudonymize(docs, pii.session_key(spark), counted=None)
    return hidden.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else hidden


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids."""
    import public_tokenizers

    on_workers(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("pii", hide_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again; what a stage read is removed after it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
