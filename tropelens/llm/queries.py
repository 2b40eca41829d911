"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tropelens.llm import decontaminate, fim, language, licenses, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, toxicity, vector_codes, warc
from tropelens.session import ship

MODULES = {
    "op1_quality_rules": quality_rules,
    "op2_ngram_jaccard_join": ngram_join,
    "op3_license_scan": licenses,
    "op4_source_mixing": mixing,
    "op5_warc_bundles": warc,
    "op6_language_id": language,
    "op7_line_dedup": line_dedup,
    "op8_toxicity": toxicity,
    "op9_decontamination": decontaminate,
    "op10_quality_classifier": quality_classifier,
    "op11_packing": packing,
    "op12_vector_codes": vector_codes,
    "op13_fill_in_middle": fim,
}


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: shipped(module.query) for name, module in MODULES.items()}
SQL = {name: module.SQL for name, module in MODULES.items() if hasattr(module, "SQL")}
