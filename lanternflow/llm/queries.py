"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanternflow.llm import (
    alignment,
    bpe,
    compression_rules,
    fingerprints,
    jaccard_join,
    kmeans,
    line_dedup,
    maxent_lm,
    packing,
    pii,
    quality_classifier,
    substring_dedup,
    token_files,
)

MODULES = (jaccard_join, line_dedup, bpe, compression_rules, maxent_lm, quality_classifier, packing, substring_dedup, fingerprints, pii, token_files, kmeans, alignment)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: q for m in MODULES for k, q in m.SQL.items()}
