"""Queries of the training-data operators, one an operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mergeloom.llm import html, languages, neardups, neighbours, passages, quality, toxicity
from mergeloom.llm.automaton import encode_documents
from mergeloom.llm.counts import count_documents
from mergeloom.llm.oracles import SQL
from mergeloom.llm.packing import pack_documents
from mergeloom.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit_lexicon(spark, docs, _table(spark, sf_dir, "labels")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return languages.identify(docs, languages.fit_languages(spark, docs))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, _table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.near_groups(spark, _table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit_quality(spark, docs, _table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(spark, _table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(spark, _table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every vector whose id 100 divides, among all vectors."""
    return neighbours.nearest(spark, _table(spark, sf_dir, "embeddings"), every=100)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit_field(pages))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, _table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_bpe_automaton, op4_jaccard_join, op5_quality_rules, op6_token_counts, op7_repeated_passages, op8_nearest_neighbours, op9_html_extraction, op10_packing)}

__all__ = ["QUERIES", "SQL"]
