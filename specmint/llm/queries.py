"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specmint.llm.decontaminate import op4_decontaminate
from specmint.llm.langid import op5_language_id
from specmint.llm.licenses import OP1_SQL, op1_license_scan
from specmint.llm.line_dedup import OP6_SQL, op6_line_dedup
from specmint.llm.masked_lm import op8_lm_scoring
from specmint.llm.mixing import op3_mixing
from specmint.llm.quality_rules import op2_quality_rules
from specmint.llm.records import op7_token_records
from specmint.llm.rule_ensemble import op9_quality_classifier
from specmint.llm.simhash import op10_simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_quality_rules": op2_quality_rules,
        "op3_mixing": op3_mixing,
        "op4_decontaminate": op4_decontaminate,
        "op5_language_id": op5_language_id,
        "op6_line_dedup": op6_line_dedup,
        "op7_token_records": op7_token_records,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": OP1_SQL, "op6_line_dedup": OP6_SQL}
