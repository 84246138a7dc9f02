"""The subpackage's registered queries, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliolake.llm import decontamination, exact_dedup, manifest, quality_rules, warc_fixity
from foliolake.llm.decontamination import op8_decontamination
from foliolake.llm.exact_dedup import op11_exact_dedup
from foliolake.llm.html_extract import op9_html_extract
from foliolake.llm.manifest import op12_merkle_manifest
from foliolake.llm.packing import op3_best_fit_packing
from foliolake.llm.periodic_runs import op13_periodic_runs
from foliolake.llm.quality_classifier import op5_quality_classifier
from foliolake.llm.quality_rules import op4_quality_rules
from foliolake.llm.secret_scan import op6_secret_scan
from foliolake.llm.simhash import op2_simhash_near_dedup
from foliolake.llm.token_counts import op7_token_counts
from foliolake.llm.token_store import op10_token_files
from foliolake.llm.warc_fixity import op1_warc_fixity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_fixity": op1_warc_fixity,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_html_extract": op9_html_extract,
    "op10_token_files": op10_token_files,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_fixity": warc_fixity.ORACLE_SQL,
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op8_decontamination": decontamination.ORACLE_SQL,
    "op11_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_merkle_manifest": manifest.ORACLE_SQL,
}
