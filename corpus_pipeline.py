"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
in the shared folder and reads it again as the next stage's docs. All but the last stage return the
columns of documents:
- quality: documents that the quality classifier rejects go;
- near_dedup: of each group of near-duplicates one document stays, the one of the smallest doc_id;
- secrets: every span found is replaced by its kind in angle brackets, and n_chars follows the text;
- mix: a document appears as often as the mix of the sources takes it (0, 1 or 2 times);
- bpe: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded text.
Rows that are repeated by the mix are repeated in the result.

Defined results: a null or empty text is scored by the classifier's bias alone and stays if that accepts it, has no copies and no
secrets, and is mixed in as often as its source takes every document (it adds no words); very long texts pass every stage whole. Rows with one id
and equal texts are copies of each other, those with one id and different texts are documents of their own; rows
without an id are never copies and stay until the mix. Of tied copies the smallest id stays, and ties in the mix go by hash. An
empty table gives an empty result with the same columns. Each stage keeps the columns it is given, whatever
their names; run() starts from the columns of documents alone. The folders that hold a stage's rows are deleted once
the next stage is written, but for the last two, which the result may still be read from.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepool.llm import bpe, mixing, near_dedup, quality, secret_scan
from tidepool.llm.common import delete, new_path, table, written
from tidepool.llm.queries import bpe_digest

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digest(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
    ("bpe", bpe_stage),
]

#: Trained scores, hashed bands and drawn copies are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, paths = table(spark, sf_dir, "documents").select(*COLUMNS), []
    for name, stage in STAGES[:-1]:
        paths.append(new_path(spark, f"pipeline-{name}"))
        docs = written(stage(spark, docs, sf_dir), name, paths[-1])
        for path in paths[:-2]:
            delete(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
