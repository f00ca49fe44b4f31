"""The operators bound to the test tables, each over its whole table with its own defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .common import table
from .contamination import contaminated
from .debruijn import dedup_substrings
from .language import language_report
from .katz import katz_scores
from .lattice import near_vectors
from .line_dedup import dedup_lines
from .merkle import manifest
from .mixing import mix_plan
from .repair import repair_report
from .secrets import secret_report
from .sharding import shard_plan
from .simhash import simhash_report
from .warc import roundtrip


def op1_lattice_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all vectors; see `near_vectors` for nulls, ties and empty tables."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text; see `secret_report` for nulls, long texts and empty tables."""
    return secret_report(table(spark, sf_dir, "documents"))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and a slot for every document; see `shard_plan` for nulls, repeated rows and empty tables."""
    return shard_plan(table(spark, sf_dir, "documents"))


def op4_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that documents hold; see `contaminated` for nulls, long texts and empty tables."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text; see `language_report` for nulls, ties and empty tables."""
    return language_report(table(spark, sf_dir, "documents"))


def op6_chunked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks of lines; see `dedup_lines` for nulls, repeated rows and empty tables."""
    return dedup_lines(table(spark, sf_dir, "documents"))


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document; see `simhash_groups` for nulls, repeated rows and empty tables."""
    return simhash_report(table(spark, sf_dir, "documents"))


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text; see `katz_scores` for nulls, long texts and empty tables."""
    return katz_scores(table(spark, sf_dir, "documents"))


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through archives and back; see `roundtrip` for nulls, equal payloads and empty tables."""
    return roundtrip(table(spark, sf_dir, "pages"))


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; see `mix_plan` for nulls, ties and empty tables."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op11_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for every conversation; see `repair_report` for nulls, ties and empty tables."""
    return repair_report(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf and its proof for every document; see `manifest` for nulls, ties and empty tables."""
    return manifest(table(spark, sf_dir, "documents"))


def op13_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated runs of words leave of every document; see `dedup_substrings` for nulls, ties and empty tables."""
    return dedup_substrings(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lattice_neardup,
        op2_trigram_secrets,
        op3_vector_packing,
        op4_minhash_containment,
        op5_rank_profiles,
        op6_chunked_lines,
        op7_simhash_bktree,
        op8_katz_backoff,
        op9_warc_bundles,
        op10_pareto_mix,
        op11_audit_repair,
        op12_merkle_manifest,
        op13_debruijn_spans,
    )
} | {"pipeline": corpus_pipeline.run}
