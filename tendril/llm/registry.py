"""Queries of the training-data operators and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tendril.llm import (
    attention_lm,
    budget_mixing,
    chunked_bpe,
    divergence_rules,
    embedding_forest,
    interaction_audit,
    pii_anchors,
    quality_qda,
    secret_structure,
    shared_cuts,
    simhash_bk,
    toxicity_cnn,
    url_association,
)
from tendril.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_embedding_forest", embedding_forest.oracle())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.embedding_components(table(spark, sf_dir, "embeddings"))


@register("op2_toxicity_cnn")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_cnn.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op3_divergence_rules", divergence_rules.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules.judge(table(spark, sf_dir, "documents"))


@register("op4_url_association", url_association.oracle())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_association.judge_urls(table(spark, sf_dir, "pages"))


@register("op5_pii_anchors")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_anchors.personal_data_digests(table(spark, sf_dir, "documents"))


@register("op6_budget_mixing", budget_mixing.oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_mixing.epochs(table(spark, sf_dir, "documents"))


@register("op7_chunked_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    return chunked_bpe.digests(table(spark, sf_dir, "documents"), path, tokenizers.PATTERN)


@register("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.simhash_components(table(spark, sf_dir, "documents"))


@register("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_secret_structure")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_structure.secret_digests(table(spark, sf_dir, "documents"))


@register("op11_attention_lm")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.lm_scores(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


@register("op12_shared_cuts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shared_cuts.alignment_digests(docs, _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


@register("op13_interaction_audit", interaction_audit.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
