"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, jaccard, line_dedup, packing, pii, quality, secrets, suffix, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_secret_scans": secrets.op4_secret_scans,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_personal_data": pii.op6_personal_data,
    "op7_suffix_dedup": suffix.op7_suffix_dedup,
    "op8_packing": packing.op8_packing,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_warc_revisits": warc.op10_warc_revisits,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_chat_formatting": chat.ORACLE,
    "op3_decontamination": decontaminate.ORACLE,
    "op10_warc_revisits": warc.ORACLE,
}
