"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP2_SQL, op2_decontamination
from .html_text import op10_html_text
from .license_scan import op6_license_scan
from .minhash_dedup import op7_minhash_dedup
from .quality_classifier import op1_quality_classifier
from .quality_rules import OP9_SQL, op9_quality_rules
from .source_mix import OP5_SQL, op5_source_mix
from .substring_dedup import op3_substring_dedup
from .suffix_dedup import op4_suffix_dedup
from .token_files import op8_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_decontamination": op2_decontamination,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_source_mix": op5_source_mix,
        "op6_license_scan": op6_license_scan,
        "op7_minhash_dedup": op7_minhash_dedup,
        "op8_token_files": op8_token_files,
        "op9_quality_rules": op9_quality_rules,
        "op10_html_text": op10_html_text,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op5_source_mix": OP5_SQL, "op9_quality_rules": OP9_SQL}
