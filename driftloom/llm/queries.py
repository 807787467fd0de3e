"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import embedding_join, jaccard_join, language_id, license_scan, merkle_manifest, mixing, packing, quality_classifier, quality_rules, sharding, substring_dedup, token_alignment, token_counts

MODULES = (sharding, mixing, jaccard_join, embedding_join, quality_rules, token_counts, packing, license_scan, language_id, quality_classifier, merkle_manifest, token_alignment, substring_dedup)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
