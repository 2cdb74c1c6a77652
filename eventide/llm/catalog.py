"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from . import collocations, decontaminate, entropy_mix, lexical_search, license_scan, outliers, packed_tokens, pu_quality, simhash, suffix_dedup, suffix_tree_lm, url_filter, weak_toxicity

ORACLES: dict[str, str] = {
    "op11_collocations": collocations.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
    "op2_license_scan": license_scan.ORACLE,
    "op3_benchmark_hits": decontaminate.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package()
        return query(spark, sf_dir)

    return run


QUERIES = {
    name: _shipped(query)
    for name, query in {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op10_suffix_tree_lm": suffix_tree_lm.op10_suffix_tree_lm,
        "op11_collocations": collocations.op11_collocations,
        "op12_lexical_search": lexical_search.op12_lexical_search,
        "op13_weak_toxicity": weak_toxicity.op13_weak_toxicity,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_benchmark_hits": decontaminate.op3_benchmark_hits,
        "op4_robust_outliers": outliers.op4_robust_outliers,
        "op5_entropy_mix": entropy_mix.op5_entropy_mix,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_packed_tokens": packed_tokens.op7_packed_tokens,
        "op8_simhash_components": simhash.op8_simhash_components,
        "op9_pu_quality": pu_quality.op9_pu_quality,
    }.items()
}
