"""Queries of the corpus operators over whole tables, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontamination, license_scan, line_dedup, mixing, ngram_join, periodic_runs, pii, quality_classifier, quality_rules, sharding, token_alignment, toxicity, url_filter
from millrace.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mix": lambda s, d: mixing.op1_mix(table(s, d, "documents")),
        "op2_ngram_join": lambda s, d: ngram_join.op2_ngram_join(table(s, d, "documents")),
        "op3_decontamination": lambda s, d: decontamination.op3_decontamination(table(s, d, "documents"), table(s, d, "benchmark")),
        "op4_quality_rules": lambda s, d: quality_rules.op4_quality_rules(table(s, d, "documents")),
        "op5_pii": lambda s, d: pii.op5_pii(table(s, d, "documents")),
        "op6_line_dedup": lambda s, d: line_dedup.op6_line_dedup(table(s, d, "documents")),
        "op7_quality_classifier": lambda s, d: quality_classifier.op7_quality_classifier(table(s, d, "documents")),
        "op8_license_scan": lambda s, d: license_scan.op8_license_scan(table(s, d, "documents")),
        "op9_url_filter": lambda s, d: url_filter.op9_url_filter(table(s, d, "pages")),
        "op10_sharding": lambda s, d: sharding.op10_sharding(table(s, d, "documents")),
        "op11_periodic_runs": lambda s, d: periodic_runs.op11_periodic_runs(table(s, d, "documents")),
        "op12_toxicity": lambda s, d: toxicity.op12_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op13_token_alignment": lambda s, d: token_alignment.op13_token_alignment(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": mixing.OP1_SQL, "op2_ngram_join": ngram_join.OP2_SQL, "op3_decontamination": decontamination.OP3_SQL, "op4_quality_rules": quality_rules.OP4_SQL, "op6_line_dedup": line_dedup.OP6_SQL, "op8_license_scan": license_scan.OP8_SQL, "op9_url_filter": url_filter.OP9_SQL, "op10_sharding": sharding.OP10_SQL}
