"""The named queries of this folder and, where SQL can express them, their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from . import fingerprints, language, lattice, middles, packing, quality, runs, sharding, simhash, substrings, tokens, toxicity, urls
from .common import ship

_QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language_id": language.op3_language_id,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_url_filters": urls.op5_url_filters,
    "op6_packing": packing.op6_packing,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_simhash": simhash.op8_simhash,
    "op9_bpe": tokens.op9_bpe,
    "op10_sharding": sharding.op10_sharding,
    "op11_periodic_runs": runs.op11_periodic_runs,
    "op12_embedding_near_dedup": lattice.op12_embedding_near_dedup,
    "op13_fill_in_middle": middles.op13_fill_in_middle,
}

ORACLE = {"op5_url_filters": urls.ORACLE, "op12_embedding_near_dedup": lattice.ORACLE, "op13_fill_in_middle": middles.ORACLE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, q=q: q(ship(tune(spark)), sf_dir)) for name, q in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
