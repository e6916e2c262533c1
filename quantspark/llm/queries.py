"""The registered queries: each applies one operator to its whole table.

Exact top-k, hard negatives and fill-in-the-middle have a SQL text. The others learn models, hash,
refine or encode in ways SQL does not express, or take minutes there; the tests hold them against
brute force, laws or held-out rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantspark.llm import ann, bpe, infill, langid, mixing, neardup, negatives, outliers, quality, sharding, suffix, topk, warc
from quantspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op4_exact_top_k": topk.SQL,
    "op11_fill_in_middle": infill.SQL,
    "op12_hard_negatives": negatives.SQL,
}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of_documents(table(spark, sf_dir, "documents"))


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_of_documents(table(spark, sf_dir, "documents"))


@query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes_of_documents(table(spark, sf_dir, "documents"))


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_of_documents(table(spark, sf_dir, "documents"))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


@query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed_of_documents(table(spark, sf_dir, "documents"))


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives_of_pages(table(spark, sf_dir, "pages"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(table(spark, sf_dir, "documents")))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.negatives_of_embeddings(table(spark, sf_dir, "embeddings"))


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(table(spark, sf_dir, "documents"))
