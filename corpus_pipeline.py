"""From raw documents to token ids: five stages, each an operator of tramline.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents. Rows are told apart by their id and a hash of their text (row), so repeated ids and null ids
are safe: null ids of one text are one row's copies like any others.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import bpe, decontaminate, quality, secrets, simhash
from tramline.store import scratch, stage

RANKS = "byte_bpe_multi_50k.tiktoken"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("row"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the classifier, which is fitted on labelled documents among these."""
    known = stage(quality.with_statistics(docs.select(*COLUMNS)), "pipeline-stats")
    counts = known.select("doc_id", *[F.col("statistics")[i].alias(c) for i, c in enumerate(quality.COUNTS)])
    forest = quality.train(counts, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality")
    return known.where(quality.verdict(forest)("statistics")).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, the row of the smallest id."""
    rows = _rows(docs)
    found = simhash.similar(rows, "row")
    first = found.where(F.col("row") == F.col("component_id")).select("row").distinct()
    return rows.join(first, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found."""
    rows = _rows(docs)
    found = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row")
    return rows.join(found.select("row").distinct(), "row", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    found = secrets.scan(docs.select(*COLUMNS), scratch(spark, "pipeline-ledger"), COLUMNS, with_text=True)
    return found.select(
        "doc_id", F.coalesce("redacted", "text").alias("text"), "lang", "source", F.when(F.col("redacted").isNull(), F.col("n_chars")).otherwise(F.length("redacted").cast("long")).alias("n_chars")
    )


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the bytes that they decode to."""
    ids = bpe.encode(docs, ["doc_id", "lang", "source"], RANKS, public_tokenizers.PATTERN)
    raw = bpe.decode(ids, ["doc_id", "lang", "source", "n_tokens", "token_ids"], RANKS, public_tokenizers.PATTERN)
    return raw.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", redact_secrets),
    ("byte-level BPE", tokenize),
]

#: SQL can express neither the classifier, the retrieval nor the encoding; tests compare with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
    return docs
