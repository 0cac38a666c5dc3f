"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_extract, language, mixing, paragraph_sketch, quality, simhash, suffix, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": html_extract.op1_main_text,
        "op2_suffix_dedup": suffix.op2_suffix_dedup,
        "op3_paragraph_sketch": paragraph_sketch.op3_paragraph_sketch,
        "op4_language": language.op4_language,
        "op5_quality": quality.op5_quality,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_chat_format": chat.op7_chat_format,
        "op8_simhash": simhash.op8_simhash,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": suffix.ORACLE_SQL, "op7_chat_format": chat.ORACLE_SQL, "op9_decontaminate": decontaminate.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL}
