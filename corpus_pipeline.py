"""A training-data pipeline: documents go through five stages, each written and read again.

Every stage works on all rows that the one before kept, and its decisions take effect: documents
leave, or their text changes. All stages but the last return the columns of documents; n_chars
follows the text. Nulls, repeated rows and empty tables go through as the operators state it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm import bpe, contamination, quality, secrets, similarity
from loanlens.llm.catalog import TOKENIZER, table, tokenizer_path
from loanlens.llm.rows import own_name
from loanlens.llm.storage import new_path, remove_folder

c = F.col

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = table(spark, sf_dir, "labels")
    name = own_name(docs.columns, "judgement")
    judged = quality.judge(docs, labels, c("source"), c("lang"))
    return judged.where(c(f"{name}.keep")).drop(name)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays.

    Documents without an id are in no group and stay. Of rows that repeat an id one stays, by the
    digest of its text.
    """
    return similarity.one_of_each_group(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which a benchmark's windows cover one word in twenty."""
    name = own_name(docs.columns, "found")
    found = contamination.search_rows(docs, table(spark, sf_dir, "benchmark"), name, window=13)
    return found.where(~contamination.contaminated(5, f"{name}.")).drop(name)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in a text are replaced by a mark; n_chars is counted again."""
    clean = secrets.redact_rows(docs, secrets.own_ledger(spark))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that they decode to."""
    name = own_name(docs.columns, "found")
    found = bpe.encode_rows(docs, tokenizer_path(TOKENIZER), name)
    return found.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        c(name)["n_tokens"].alias("n_tokens"),
        c(name)["ids"].alias("ids"),
        F.sha2(c(name)["decoded"], 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("bpe_encode_decode", encode),
]

#: A trained classifier decides, which SQL cannot express; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder, before = new_path(spark, "pipeline"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return docs
