"""From raw documents to token ids: five stages, each one operator of ``tendril.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; its result is stored as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``:

1. ``quality_classifier`` drops the documents that the classifier rejects;
2. ``simhash_near_dedup`` keeps one document of each near-duplicate group;
3. ``secret_scans`` masks confirmed and patterned secrets in the texts;
4. ``mixing_to_weights`` repeats or leaves out documents to meet the target
   weights of domains, languages and sources;
5. ``byte_level_bpe`` encodes every text and decodes it again: ``doc_id``,
   ``n_tokens``, ``ids`` and whether the decoded bytes are those of the text.

The stages set two batch sizes of the session (``BATCHES``).

Rows with null texts count as empty documents, null ids are kept as they are,
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.llm import budget_mixing, chunked_bpe, quality_qda, secret_structure, simhash_bk
from tendril.llm.common import table
from tendril.session import checkpoint_path

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Rows that are read, or handed to a Python worker, at once: texts are long, and with
#: Spark's own settings (given here as well) a batch of them is tens of megabytes in
#: every task, which workers and executors then keep from stage to stage.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}


def _small_batches(spark: SparkSession) -> None:
    """Sets ``BATCHES`` for the session, unless it has settings of its own."""
    for name, (default, ours) in BATCHES.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, ours)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return quality_qda.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return simhash_bk.drop_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return secret_structure.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return budget_mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    path = public_tokenizers.path(TOKENIZER)
    coded = chunked_bpe.encode_decode(docs, path, public_tokenizers.PATTERN, keep=["text"])
    same = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("secret_scans", secret_stage),
    ("mixing_to_weights", mixing_stage),
    ("byte_level_bpe", bpe_stage),
]

#: SQL cannot express the classifier, the fingerprints' hash or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored under the
    shared checkpoint folder, so a lost executor costs no earlier stage."""
    base = checkpoint_path(spark, f"corpus-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        at = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
